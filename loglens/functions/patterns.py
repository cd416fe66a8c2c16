"""Fixed values that must equal the analysed tool's behaviour.

Everything below is data (regular expressions, label names, thresholds,
word lists). They are written out plainly, in the order the original
tool applies them, so that results line up with it. Regexes use the
Java dialect (Spark) and are also valid RE2 (DuckDB oracle).
"""

# --------------------------------------------------------------------------
# FIXED VALUES: error classes of the class-keyed evidence map, in order.
# (label, case-insensitive regex)
# --------------------------------------------------------------------------
CLASS_RULES = [
    ("OutOfMemoryError", r"OutOfMemoryError"),
    ("GC_overhead", r"GC overhead limit exceeded"),
    ("Executor_lost", r"(executor lost|lost executor)"),
    ("Task_failure", r"(task failed|Task.*failed)"),
    ("Connection_error", r"(connection.*refused|connection.*timeout)"),
    ("Shuffle_fetch_failure", r"(shuffle.*fetch.*fail|FetchFailed)"),
    ("ERROR", r"ERROR"),
    ("WARN", r"WARN"),
    ("Exception", r"Exception"),
]

# FIXED VALUES: short timestamp of the class map, first hit wins.
SHORT_TS_PATTERNS = [
    r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})",
    r"(\d{2}:\d{2}:\d{2})",
    r"(\d+\.\d+s)",
]

# FIXED VALUES: typed variables of the class map, first match per type.
# (regex with one group, type prefix)
TYPED_VARIABLE_RULES = [
    (r"executor[- ]?(\d+)", "executor_id"),
    (r"task[- ]?(\d+)", "task_id"),
    (r"stage[- ]?(\d+)", "stage_id"),
    (r"(\d+\.\d+\.\d+\.\d+)", "ip_address"),
]

# FIXED VALUES: full timestamp of the template map, first hit wins.
# (regex, anchored at line start?)  The second one is searched anywhere.
FULL_TS_PATTERNS = [
    r"^(\d{2,4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2})",
    r"\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\]]*)\]",
    r"^(\d{10,}\.\d+)s?\s",
]

# FIXED VALUES: log levels that mark a line as "leveled" for templating.
LOG_LEVELS = ["FATAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE"]

# FIXED VALUES: the seven normalising rewrites, applied in this order,
# case-insensitive. (regex, replacement)
NORMALIZE_RULES = [
    (r"\bexecutor\s+\d+\b", "executor *"),
    (r"\btask\s+\d+(?:\.\d+)?\b", "task *"),
    (r"\bTID\s+\d+\b", "TID *"),
    (r"\bstage\s+\d+(?:\.\d+)?\b", "stage *"),
    (r"\bpartition\s+\d+\b", "partition *"),
    (r"\b0x[0-9a-fA-F]+\b", "0x*"),
    (r"\bThread-\d+\b", "Thread-*"),
]

# Template key: timestamp + level + logger prefix ("strip_prefix" mode).
LEVEL_PREFIX = r"^.*?\b(?:FATAL|ERROR|WARN|WARNING|INFO|DEBUG|TRACE)\b[^:]*:"

# --------------------------------------------------------------------------
# FIXED VALUES: GC line shapes, tried in this order, case-insensitive.
# A: mem triple then duration; B: duration then mem triple; C: duration only.
# Groups (A): ts, event, id, desc, before, after, heap, dur
# Groups (B): ts, event, id, desc, dur, before, after, heap
# Groups (C): ts, event, id, desc, dur
# --------------------------------------------------------------------------
_GC_HEAD = r"(\d+(?:\.\d+)?)s.*?(GC\((\d+)\))(.*?)"
_GC_MEM = (r"(\d[\d,\.]*[KMGT])\s*->\s*(\d[\d,\.]*[KMGT])\s*\(\s*"
           r"(\d[\d,\.]*[KMGT])\s*\)")
_GC_DUR = r"(\d[\d,\.]*\s*(?:ms|s))"
GC_SHAPE_A = "(?i)" + _GC_HEAD + _GC_MEM + ".*?" + _GC_DUR
GC_SHAPE_B = "(?i)" + _GC_HEAD + _GC_DUR + ".*?" + _GC_MEM
GC_SHAPE_C = "(?i)" + _GC_HEAD + _GC_DUR
# A cheap necessary condition shared by all three shapes.
GC_PREFILTER = r"(?i)\d+(?:\.\d+)?s.*?GC\(\d+\)"

# FIXED VALUES: size units (binary) of the GC parser.
SIZE_UNITS = [("K", 1024), ("M", 1024 ** 2), ("G", 1024 ** 3), ("T", 1024 ** 4)]

# FIXED VALUES: GC description classes, first hit wins.
# (kind, short name, stop-the-world, full, substrings of the lower-cased text)
GC_KINDS = [
    ("pause_young", "Young", True, False, ["pause young"]),
    ("pause_full", "Full", True, True, ["pause full", "(full gc"]),
    ("remark", "Remark", True, False, ["pause remark"]),
    ("cleanup", "Cleanup", True, False, ["pause cleanup"]),
    ("concurrent", "Concurrent", False, False, ["concurrent"]),
]

# FIXED VALUES: executor health thresholds and labels.
HEALTH_FULL_HEAVY = 15
HEALTH_FULL_MODERATE = 5
HEALTH_LONG_PAUSE_MS = 1000.0
HEALTH_HEAP_PCT = 90.0
STATUS_HEAVY = "⚠️ Heavy GC activity"
STATUS_MODERATE = "⚠️ Moderate GC activity"
STATUS_HEALTHY = "✅ Healthy"
ISSUE_EXCESSIVE_FULL = "Excessive Full GCs"
ISSUE_HIGH_FULL = "High Full GC count"
ISSUE_LONG_PAUSE = "Long pause ({:.2f}s)"          # seconds
ISSUE_HEAP_PRESSURE = "High heap pressure ({:.0f}%)"

# FIXED VALUES: GC configuration table (parameter names and value formats)
CONFIG_MAX_HEAP = "Max Heap Size"
CONFIG_ALGORITHM = "GC Algorithm"
CONFIG_XMX_FORMAT = "{value} GB (-Xmx{arg})"
CONFIG_OBSERVED_FORMAT = "{value} GB (~observed)"

# FIXED VALUES: GC algorithm markers, first hit wins.
GC_ALGORITHMS = [
    ("G1 Garbage Collector", ["G1"]),
    ("Parallel GC", ["ParallelGC", "PSYoungGen"]),
    ("Concurrent Mark Sweep (CMS)", ["CMS"]),
]

# --------------------------------------------------------------------------
# FIXED VALUES: case-control policy.
# --------------------------------------------------------------------------
MAX_OUTER_ITERATIONS = 6
MAX_ANALYZE_PARSE_LOOPS = 6
CONFIDENCE_THRESHOLD = 0.75
CRITIC_MAX_ADJUST = 0.25
CRITIC_MIN_CONFIDENCE = 0.6
CRITIC_LOW_DEFAULT = ("Confidence is too low (< 0.6). Please gather more "
                      "evidence or refine the hypothesis.")
CRITIC_LOW_PREFIX = "Confidence too low ({:.2f}). "
INPUT_ERROR_PROBLEM = ("System Configuration Error: Unable to perform analysis due to "
                       "missing or invalid inputs.")
INPUT_ERROR_MITIGATION = ("1. Verify that 'logs_path' is provided in the initial state\n"
                          "2. Ensure logs_path points to a valid Unity Catalog volume path\n"
                          "3. Check that the path is accessible and contains Spark log files\n"
                          "4. Re-run the analysis with correct configuration")
NO_LOGS_PATH_SAMPLE = "[CRITICAL ERROR] No logs path provided in the initial state."
NO_KEYWORDS_SAMPLE = "[ERROR] No keywords provided for search. Path: "
PROBLEM_UNSPECIFIED = "Problem: (unspecified)"
RCA_UNSPECIFIED = "RCA: (unspecified)"
MITIGATION_UNSPECIFIED = "Mitigation: (unspecified)"
NO_LOGS_PATH_KEY = "CRITICAL_ERROR_NO_LOGS_PATH"
NO_KEYWORDS_KEY = "error_no_keywords"
KEYWORD_CAP = 15
DEFAULT_KEYWORDS = ["ERROR", "Exception", "Executor lost", "OutOfMemoryError",
                    "GC overhead", "Container exited"]
# keywords that make a case a memory suspect (GC analysis wanted)
MEMORY_HINTS = ["gc", "heap", "memory", "oom", "pause"]
# evidence keys that mark unusable input
FATAL_INPUT_MARKERS = ["CRITICAL_ERROR", "error_no"]
CLAIM_PROVEN = "[PROVEN]"
CLAIM_INFERRED = "[INFERRED]"

# FIXED VALUES: drill-down rules of the causal chain:
# (symptom class, suspected cause, keyword to search for that cause)
DRILLDOWN_RULES = [
    ("Stage_failure", "Executor_lost", "executor lost"),
    ("Stage_failure", "Task_failure", "task failed"),
    ("Executor_lost", "OutOfMemoryError", "OutOfMemoryError"),
    ("Executor_lost", "Spot_termination", "spot instance"),
    ("Executor_lost", "Container_killed", "Container killed"),
    ("OutOfMemoryError", "Memory_config", "spark.executor.memory"),
    ("OutOfMemoryError", "Data_skew", "skew"),
    ("OutOfMemoryError", "Large_objects", "large object"),
]
