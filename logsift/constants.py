"""Fixed values that must equal the behaviour being reproduced.

Everything here is a plain value (text, numbers, ordered lists), kept together and in
natural order so it can be read against the documented behaviour.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — limits and markers
# ---------------------------------------------------------------------------
MAX_ARTIFACT_MIB = 50
MAX_FILES_PER_REQUEST = 15
MIN_SNIPPET_LEN = 100
DEFAULT_SNIPPET_LEN = 2000
DEFAULT_MAX_CLUSTERS = 8
TRUNCATED = "<truncated>"
TRUNCATE_MIDDLE = "\n...<truncated>...\n"
SNIPPET_DELIMITER = "================"
ARCHIVE_MAX_AGE_DAYS = 90
TASK_ANALYSIS_TIMEOUT_MIN = 15
NEAREST_DEFAULT_K = 1
NEAREST_MAX_K = 3
EMBEDDING_DIM = 384

ARTIFACT_NAME_RE = r"^[a-zA-Z0-9._\-/ ]+$"

# ---------------------------------------------------------------------------
# FIXED VALUES — redaction rules, applied in this order (pattern, replacement)
# ---------------------------------------------------------------------------
REDACT_EMAIL_RE = (
    r"\b[\w.%+-]+(?:@|\(at\)|\[at\])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.){1,10}[a-z]{2,4}\b"
)
REDACT_EMAIL_WITH = "copr-team@redhat.com"
REDACT_FINGERPRINT_RE = r"\bFingerprint:\s*([0-9A-F]{32,64}|(?:\s*[0-9A-F]{4}){8,16})\b"
REDACT_FINGERPRINT_WITH = "Fingerprint:" + " FFFF" * 10
REDACT_RSA_RE = r"\bRSA\s+key\s+[0-9A-F]{16,512}\b"
REDACT_RSA_WITH = "RSA key " + "FFFF" * 10
REDACT_PUBKEY_RE = r"\bpubkey-[0-9A-F]{8}[0-9A-F-]{8,128}\b"
REDACT_PUBKEY_WITH = "pubkey-" + "ffff" * 10

# ---------------------------------------------------------------------------
# FIXED VALUES — template-mining masks, applied in this order (pattern, tag)
# ---------------------------------------------------------------------------
MASK_RULES = [
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "ID"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "IP"),
    (r"((?<=[^A-Za-z0-9])|^)[0-9a-f]{6,}( [0-9a-f]{6,}){2,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)[0-9A-F]{4,}( [0-9A-F]{4,}){3,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "HEX"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "NUM"),
    (r"(?<=executed cmd )(\".+?\")", "CMD"),
    (r"/usr/bin/systemd-nspawn.*", "CMD"),
    (r"INFO: .*", "INFO"),
]
# A literal every match of the rule contains (None: no cheap guard); used only to skip work.
MASK_GUARDS = {"ID": ":", "IP": ".", "HEX": "0x", "CMD": None, "INFO": "INFO: "}
MASK_PREFIX = "<:"
MASK_SUFFIX = ":>"
TEMPLATE_SIM_TH = 0.4
TEMPLATE_DEPTH = 4
TEMPLATE_EXTRA_DELIMITERS = ["_"]
WILDCARD = "<*>"

# ---------------------------------------------------------------------------
# FIXED VALUES — default noise rules (name, pattern, files or None), in file order
# ---------------------------------------------------------------------------
DEFAULT_NOISE_RULES = [
    ("child_exit_code_zero", r".*Child return code was: 0", None),
    ("mock_lifecycle_start", r"^Start[:(]", None),
    ("mock_lifecycle_finish", r"^Finish[:(]", None),
    ("mock_debug", r"^DEBUG ", ["mock_output.log"]),
    ("mock_info", r"^INFO ", ["mock_output.log"]),
    ("mock_info_colon", r"^INFO: ", ["mock_output.log"]),
    ("mock_deprecation", r"^ERROR: Option .* has been deprecated", None),
    ("mock_nspawn_command_failed", r"^ERROR: Command failed:", None),
    ("koji_exception_wrapper", r"^ERROR: Exception\(", None),
    ("mock_version", r"^Mock Version:", None),
    ("test_non_failure", r".*(PASSED|XFAIL|SKIPPED)\s+\[", None),
    ("test_bracket_non_failure", r"^\[\s+(PASSED|OK|RUN)", None),
    ("test_bracket_separator", r"^\[[-=]", None),
    ("pytest_section", r"^=+\s", None),
    ("rpm_build_header", r"^RPM build (warnings|errors):", None),
    ("port_server", r".*[Pp]ort server", None),
    ("koji_buildroot", r".*koji\.build\.buildroot", None),
    ("pkg_nvr", r"^[a-z].*\.(noarch|x86_64|i686|aarch64|ppc64le|s390x)$", None),
    ("kernel_version", r"^\d+\.\d+\.\d+", None),
    ("shell_trace", r"^\+\+? ", None),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — python traceback markers
# ---------------------------------------------------------------------------
TB_HEADER = "Traceback (most recent call last):"
TB_CHAIN = [
    "During handling of the above exception, another exception occurred:",
    "The above exception was the direct cause of the following exception:",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — failed-log selection
# ---------------------------------------------------------------------------
ARCH_PREFERENCE = ["x86_64", "aarch64", "riscv", "ppc64le", "s390x", "noarch"]
SUBTASK_ARCH_PREFERENCE = ["x86_64", "aarch64", "riscv", "ppc64le", "s390x"]
SUBTASK_METHODS = ["buildArch", "buildSRPMFromSCM"]
TOPLEVEL_ARCH = "~toplevel"
FAILED_LOG_NAME_RE = r"(\w*\.log)"
MR_REF_RE = r"refs/merge-requests/(\d+)/.*$"
BUILD_JOB_NAME_RE = r"^build.*rpm$"
ARCHIVE_DATE_RE = r"results-(?:since-)?(\d{4}-\d{2}-\d{2})"

# ---------------------------------------------------------------------------
# FIXED VALUES — enumerations
# ---------------------------------------------------------------------------
ENDPOINTS = ["analyze", "analyze_gitlab_job", "analyze_koji_task"]

# Defaults of the forge parameter; deployments pass their own list.
FORGES = ["https://gitlab.com", "https://forge.example.com/"]
