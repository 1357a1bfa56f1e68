"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The vocabulary comes from a rank file (one base64 token and its rank per line); its path is a
parameter and its content travels with the job, so executors need no copy of the file. Text is
cut by the given pattern, bytes are mapped to printable characters, and the library's BPE model
merges by rank. Special-token strings in a text are ordinary text.

Every match of the pattern is encoded by itself, so equal matches have equal ids: a worker sends
each distinct match of a batch to the library once and keeps a bounded table of those it has seen.

``ids`` decode to the exact bytes of the text. ``offsets`` are code-point spans in the text; tokens
that hold parts of one character all carry that character's span.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import bounded_batches, text_or_empty


def byte_characters() -> list[str]:
    """Character of each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Merges in rank order: every way to make a token from two tokens of lower rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None and a < rank and b < rank:
                out.append((token[:cut], token[cut:]))
    return out


class Vocabulary:
    """A byte-level vocabulary that travels to the tasks as one JSON text of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        chars = byte_characters()
        shown = {token: "".join(chars[b] for b in token) for token in ranks}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.pattern = pattern
        self.spec = json.dumps({"vocab": {shown[t]: r for t, r in ranks.items()},
                                "merges": [(shown[a], shown[b]) for a, b in merges_of(ranks)]})

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        return cls(read_ranks(path), pattern)


#: Matches a worker remembers, and the longest that it remembers (bounds its memory to about 30 MB).
SEEN, SEEN_CHARS = 150_000, 40


def _library(spec: str, cut):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer, models, pre_tokenizers
    told = json.loads(spec)
    made = Tokenizer(models.BPE(vocab=told["vocab"], merges=[tuple(m) for m in told["merges"]], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        *cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.encode_special_tokens = True
    return made


@functools.lru_cache(maxsize=1)
def _whole_texts(spec: str, pattern: str):
    from tokenizers import Regex, pre_tokenizers
    return _library(spec, [pre_tokenizers.Split(Regex(pattern), "isolated")])


@functools.lru_cache(maxsize=1)
def _matches(spec: str, pattern: str):
    return _library(spec, []), regex.compile(pattern), {}


@functools.lru_cache(maxsize=1)
def _byte_table(spec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, and where each id's bytes start and how many they are."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocab = json.loads(spec)["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for shown, i in vocab.items():
        tokens[i] = bytes(byte_of[c] for c in shown)
    length = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def encode_batch(texts: list[str], vocabulary: Vocabulary, offsets: bool = False):
    """Ids of each text, and with ``offsets`` the (start, end) code points of each token."""
    if offsets:
        found = _whole_texts(vocabulary.spec, vocabulary.pattern).encode_batch(texts, add_special_tokens=False)
        return [e.ids for e in found], [e.offsets for e in found]
    return [np.frombuffer(x, np.int32).tolist() for x in _packed(texts, vocabulary)], None


def _packed(texts: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each text as packed 32-bit integers."""
    run, pattern, seen = _matches(vocabulary.spec, vocabulary.pattern)
    cut = [pattern.findall(t) for t in texts]
    new = list(set(itertools.chain.from_iterable(cut)).difference(seen))
    if len(seen) + len(new) > SEEN:
        seen.clear()
        new = list(set(itertools.chain.from_iterable(cut)))
    for at in range(0, len(new), 4096):
        part = new[at:at + 4096]
        seen.update((t, np.array(e.ids, np.int32).tobytes()) for t, e in zip(
            part, run.encode_batch_fast(part, add_special_tokens=False)))
    ids = [b"".join(map(seen.__getitem__, c)) for c in cut]
    for match in new:
        if len(match) > SEEN_CHARS:
            del seen[match]
    return ids


def decode_flat(ids: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many id lists at once; ``ends``: where each list ends in ``ids``."""
    data, start, length = _byte_table(vocabulary.spec)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or not length[ids].all()):
        raise ValueError("ids outside the vocabulary")
    n = length[ids]
    upto = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(start[ids] - upto[:-1], n) + np.arange(upto[-1])
    return data[at], upto[ends]


def _lists(items: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) // 4 for x in items])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(items), np.int32)))


def with_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids",
                offsets: str | None = None) -> DataFrame:
    """``docs`` plus ``out array<int>``, the ids of the whole text (null: none, as for the empty text).

    ``offsets`` names a further column ``array<struct<start,end>>`` of code-point spans. Rows are
    independent: repeated rows and any other columns pass through unchanged.
    """
    bounded_batches(docs.sparkSession)

    def ids_of(texts: pa.Array) -> pa.Array:
        return _lists(_packed(texts.to_pylist(), vocabulary))

    def both_of(texts: pa.Array) -> pa.Array:
        ids, spans = encode_batch(texts.to_pylist(), vocabulary, offsets=True)
        ends = pa.array(np.cumsum([0] + [len(x) for x in ids]), pa.int32())
        flat = np.array([p for s in spans for p in s], np.int32).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
        return pa.StructArray.from_arrays([_lists([np.array(x, np.int32).tobytes() for x in ids]), pa.ListArray.from_arrays(ends, pairs)],
                                          ["ids", "spans"])

    if not offsets:
        return docs.withColumn(out, F.arrow_udf(ids_of, "array<int>")(text_or_empty(text)))
    made = F.arrow_udf(both_of, "struct<ids array<int>, spans array<struct<start int, end int>>>")
    return docs.withColumn("__bpe", made(text_or_empty(text))).withColumn(out, F.col("__bpe.ids")) \
        .withColumn(offsets, F.col("__bpe.spans")).drop("__bpe")


def with_decoded(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` plus ``out binary``: the bytes of the ids (null ids: no bytes).

    Bytes, because a list of ids may start or end inside a character; ``cast(out as string)`` gives
    the text of whole lists, ``decode_pieces`` that of lists cut anywhere.
    """
    def bytes_of(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.asarray([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        data, ends = decode_flat(flat, np.concatenate(([0], np.cumsum(sizes))), vocabulary)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)),
                                                               pa.py_buffer(np.ascontiguousarray(data))])

    lists = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    return docs.withColumn(out, F.arrow_udf(bytes_of, "binary")(lists))


def decode_pieces(pieces: list[list[int]], vocabulary: Vocabulary) -> list[str]:
    """Text of consecutive id lists of one text; a character split over lists goes to the later one."""
    import codecs
    run, out = codecs.getincrementaldecoder("utf-8")("replace"), []
    for k, ids in enumerate(pieces):
        data, _ = decode_flat(np.asarray(ids, np.int64), np.array([0]), vocabulary)
        out.append(run.decode(data.tobytes(), final=k == len(pieces) - 1))
    return out
