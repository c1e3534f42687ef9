"""Schemas, defaults and the fixed tables that decide what counts as code."""

from __future__ import annotations

CHUNK_COLUMNS = ("id", "text", "text_sha256", "label", "label_name", "language", "source_id", "source_kind", "path", "chunk_index", "repository_url", "revision", "split")
CHUNKS = "id string, text string, text_sha256 string, label int, label_name string, language string, source_id string, source_kind string, path string, chunk_index int, repository_url string, revision string, split string"
SOURCES = "id string, kind string, label int, label_name string, url string, revision string, provenance_note string, path string, include_paths array<string>, exclude_paths array<string>, split string, source_ord int"
FILES = "source_id string, path string, name string, size bigint, content binary"
SPLITS = ("train", "validation", "test")
KINDS = ("git", "github", "samples")

# Limits and defaults.
MAX_FILE_BYTES = 256_000
MAX_CHARS = 12_000
MIN_CHARS = 40
SCAN_FILE_BYTES = 2 * 1024 * 1024
SCAN_READ_CHARS = 131_072
SCAN_MAX_FILES = 10_000
HEADER_CHARS = 4096
Z_99 = 2.575829303548901
TARGET_HALF_WIDTH = 0.05
MIN_FILES = 10
MAX_CHUNKS = 50_000
CHUNK_THRESHOLD = 0.5
WINDOW_TOKENS = 1024
WINDOW_OVERLAP = 128

# White space that ends are stripped of before a length is taken: of scanned files, and of prepared ones.
SCAN_STRIP = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
STRIP = SCAN_STRIP + "".join(map(chr, range(0x1C, 0x20)))

# Language by suffix in corpus preparation.
SUFFIX_LANGUAGE = {
    ".asm": "assembly",
    ".s": "assembly",
    ".c": "c",
    ".h": "c",
    ".clj": "clojure",
    ".cljs": "clojure",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hh": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".dart": "dart",
    ".ex": "elixir",
    ".exs": "elixir",
    ".erl": "erlang",
    ".hrl": "erlang",
    ".fs": "fsharp",
    ".fsx": "fsharp",
    ".go": "go",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".lua": "lua",
    ".m": "objective-c",
    ".mm": "objective-cpp",
    ".pl": "perl",
    ".php": "php",
    ".ps1": "powershell",
    ".py": "python",
    ".r": "r",
    ".rb": "ruby",
    ".rs": "rust",
    ".scala": "scala",
    ".bash": "shell",
    ".fish": "shell",
    ".sh": "shell",
    ".zsh": "shell",
    ".sol": "solidity",
    ".swift": "swift",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".vb": "visual-basic",
    ".vbs": "visual-basic",
    ".zig": "zig",
}
NAME_LANGUAGE = {"dockerfile": "dockerfile", "makefile": "makefile", "rakefile": "ruby"}

# Names left out of corpus preparation.
PREP_FILES = ("cargo.lock", "package-lock.json", "uv.lock")
PREP_DIRECTORIES = (
    ".cache", ".git", ".github", ".idea", ".venv", ".vscode", "__pycache__", "build", "coverage", "dist", "docs", "fixtures", "generated",
    "node_modules", "out", "target", "test", "tests", "third_party", "vendor", "venv",
)

# What a repository scan takes and leaves out.
SCAN_EXTENSIONS = (
    "bash", "c", "cc", "cjs", "clj", "cljc", "cljs", "cpp", "cs", "cxx", "d", "dart", "elm", "erl", "ex", "exs", "fish", "go", "groovy", "h", "hh",
    "hpp", "hrl", "hs", "hxx", "java", "jl", "js", "jsx", "kt", "kts", "lua", "m", "mjs", "ml", "mli", "mm", "nim", "php", "pl", "pm", "ps1", "purs",
    "py", "r", "rb", "rkt", "rs", "scala", "sh", "sql", "svelte", "swift", "tcl", "ts", "tsx", "vue", "zig", "zsh",
)
SCAN_DIRECTORIES = (
    "__pycache__", "bower_components", "build", "deps", "dist", "external", "generated", "node_modules", "obj", "out", "pods", "target",
    "third-party", "third_party", "thirdparty", "vendor", "vendored", "venv",
)
GENERATED_SUFFIXES = (
    ".bundle.js", ".designer.cs", ".freezed.dart", ".g.cs", ".g.dart", ".gen.go", ".gen.ts", ".generated.cs", ".min.css", ".min.js", ".pb.cc",
    ".pb.go", ".pb.h", ".pb.swift", "_generated.go", "_pb.js", "_pb.ts", "_pb2.py", "_pb2_grpc.py",
)
GENERATED_MARKERS = (
    "@generated",
    "auto-generated file",
    "autogenerated file",
    "automatically generated",
    "code generated by",
    "do not edit",
    "generated automatically",
    "this file is generated",
    "this file was generated",
)

# Keys of the preparation summary, in order.
SUMMARY = ("manifests", "seed", "normalization", "source_counts_before_deduplication", "records_after_deduplication", "same_label_duplicates_removed", "cross_label_conflicts_removed", "balanced", "split_counts")
NORMALIZATION = "NFC, UTF-8, LF line endings, trailing whitespace removed"
