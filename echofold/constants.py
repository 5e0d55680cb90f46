"""Fixed values that define the results; each must hold as it stands for results to agree."""

KGRAM = 10
WINDOW = 8
SCAN_THRESHOLD = 0.80
CHECK_THRESHOLD = 0.85
MIN_SHARED = 3
CONTAINMENT = 0.90
MOVE_EQUIVALENCE = 0.90
MAX_FILE_BYTES = 2 * 1024 * 1024
MIN_TOKENS = 40
CULL_FLOOR = 100
CULL_SHARE = 200
SHAPE_MIN_MEMBERS = 3
MAX_SNAPSHOTS = 36
YOUNG_MONTHS = 6
YOUNG_SNAPSHOTS = 12
TOP_CLUSTERS = 10
JSON_SCHEMA = 2
HASH_BASE = 1_000_003
# Sentinels of the normalised token stream, and the band for operator symbols below them.
IDENT_CODE, STR_CODE, NUM_CODE = 65535, 65534, 65533
OP_BAND = 4096
OP_BASE = 61436

# File extensions by language.
LANGUAGES = {
    "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "javascript": ("js", "mjs", "cjs", "jsx"), "python": ("py", "pyi"), "rust": ("rs",), "go": ("go",), "java": ("java",), "ruby": ("rb",),
    "swift": ("swift",), "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "c++", "hpp", "hh", "hxx"), "php": ("php",), "csharp": ("cs",), "kotlin": ("kt", "kts"), "scala": ("scala", "sc"),
    "clojure": ("clj", "cljc", "cljs"),
}
EXTENSIONS = {e: lang for lang, exts in LANGUAGES.items() for e in exts}

# Directories and file names left out of a scan by default.
EXCLUDED_DIRS = ("node_modules", "vendor", "third_party", "dist", "build", "out", "target", ".next", ".nuxt", ".venv", "venv", "__pycache__", ".git")
EXCLUDED_SUFFIXES = (".min.js", ".min.mjs", ".bundle.js", ".pb.go", "_pb2.py", "_pb2.pyi", "_pb2_grpc.py", ".gen.go", ".gen.ts", ".d.ts")
EXCLUDED_INFIX = ".generated."

# Names of test files and directories.
TEST_SUFFIXES = ("_test.go", "_test.py", "_test.rs", "test.java", "tests.java", "_spec.rb", "_test.rb", "tests.swift", "test.swift", "spec.swift", "test.php", "tests.php", "test.kt", "tests.kt")
TEST_NAMES = ("tests.rs", "test.rs")
TEST_PREFIXES = ("test_", "conftest.")
TEST_INFIXES = (".test.", ".spec.")
TEST_DIRS = ("tests", "test", "__tests__", "testdata", "spec")

# Marks of generated content in the first lines, and bounds of minified content in bytes.
GENERATED_MARKS = ("@generated", "do not edit", "auto-generated", "autogenerated", "code generated by")
GENERATED_HEAD = 10
MINIFIED_LINE = 2000
MINIFIED_MEAN = 300

# Grades: the first bound above the score in percent.
GRADES = ((3.0, "A"), (6.0, "B"), (10.0, "C"), (15.0, "D"))
LAST_GRADE = "F"
# Inflection of a series of scores in percent.
CLEAN_SCORE, DIRTY_SCORE, GROWTH_FACTOR = 0.05, 1.0, 1.5
# Eighth blocks for bars (left to right) and columns (bottom to top).
BAR_EIGHTHS = ("", "▏", "▎", "▍", "▌", "▋", "▊", "▉")
COLUMN_EIGHTHS = (" ", "▁", "▂", "▃", "▄", "▅", "▆", "▇", "█")
