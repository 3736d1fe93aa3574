"""Scalar column functions: paths, names, ids, text clean-up. All of them stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which paths are indexed, and as what.
SKIP_DIRS = [
    "node_modules", "dist", "build", ".git", "__pycache__", ".turbo", ".next", "coverage",
    ".nyc_output", "storybook-static", ".yarn", "vendor",
]
SKIP_SUFFIXES = [
    ".lock", ".snap", ".map", ".ico", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".woff", ".woff2",
    ".ttf", ".eot", ".pdf", ".min.js", ".min.css",
]
SKIP_NAMES = ["yarn.lock", "package-lock.json", "pnpm-lock.yaml"]
CODE_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".go", ".rs", ".sql"]
DOC_SUFFIXES = [".md", ".txt", ".rst", ".yml", ".yaml", ".toml"]

# The characters that Python's str.strip() and str.isspace() take for white space.
WHITESPACE_CLASS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def sanitise(namespace: Column) -> Column:
    """Lower-case, and every character outside ``[a-z0-9_]`` becomes an underscore."""
    return F.regexp_replace(F.lower(namespace), "[^a-z0-9_]", "_")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part of a relative path, '' at the root."""
    return F.regexp_replace(path, r"(^|/)[^/]*\z", "")


def path_suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name; '' for none, for dot files and for a final dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def keep_path(path: Column) -> Column:
    """False for paths under a skipped directory, lock files and skipped suffixes."""
    in_skipped_dir = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))
    name = base_name(path)
    lowered = F.lower(name)
    bad_suffix = F.lit(False)
    for suffix in SKIP_SUFFIXES:
        bad_suffix = bad_suffix | F.endswith(lowered, F.lit(suffix))
    return ~(in_skipped_dir | name.isin(SKIP_NAMES) | bad_suffix)


def route_kind(path: Column) -> Column:
    """'code', 'docs', or NULL for files that are not indexed."""
    suffix = path_suffix(path)
    return F.when(suffix.isin(CODE_SUFFIXES), "code").when(suffix.isin(DOC_SUFFIXES), "docs")


def is_manifest(path: Column) -> Column:
    return base_name(path) == "package.json"


def parse_repo_url(url: Column) -> Column:
    """STRUCT(owner, repo) from the last two parts of a repository URL; NULL parts when there are too few."""
    parts = F.split(F.regexp_replace(url, r"/+\z", ""), "/")
    return F.struct(
        F.try_element_at(parts, F.lit(-2)).alias("owner"),
        F.when(F.size(parts) >= 2, F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.git\z", ""))
        .alias("repo"),
    )


def chunk_label(package: Column, path: Column) -> Column:
    return F.when(F.coalesce(package, F.lit("")) != "", F.concat(package, F.lit("/"), path)).otherwise(path)


def chunk_id(namespace: Column, path: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", namespace, path, index.cast("string")), 256)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def iso_timestamp(ts: Column) -> Column:
    """Seconds, a six-digit fraction unless it is zero, and the offset as ``+00:00``."""
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != ".000000", fraction).otherwise(""),
                    F.date_format(ts, "xxx"))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def decode_utf8(content: Column) -> Column:
    """Bytes to text as a text-mode read does: bad bytes replaced, every line end ``\\n``."""
    return normalise_newlines(F.make_valid_utf8(content.cast("string")))


def has_text(text: Column) -> Column:
    """True when the text holds anything but white space."""
    return text.rlike(f"[^{WHITESPACE_CLASS}]")
