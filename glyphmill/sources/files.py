"""Files and lists: directory scans with ignore rules, suppression files, text corpora."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BYTES = 2 << 20
# Extensions by scope, folders of locale files, what is never read.
MARKUP = [".html", ".htm", ".xml", ".jsx", ".tsx", ".vue", ".svelte", ".js", ".ts", ".mjs", ".cjs"]
BACKEND = [".py", ".php", ".rb", ".erb", ".go", ".java", ".cs"]
CONTENT = MARKUP + BACKEND
TECHNICAL = [*MARKUP, ".py", ".css", ".scss", ".less", ".go", ".rs", ".java", ".kt", ".php", ".rb", ".sh", ".sql", ".c", ".h", ".cpp", ".cs", ".swift", ".yml", ".yaml", ".toml"]
LOCALE_FOLDERS = ["locales", "locale", "lang", "langs", "i18n", "translations", "translation", "messages", "strings"]
IGNORED = [
    ".git/", "node_modules/", "dist/", "build/", "out/", ".next/", ".nuxt/", ".svelte-kit/", "target/", "vendor/", "venv/", ".venv/", "env/",
    "__pycache__/", ".pytest_cache/", ".mypy_cache/", ".idea/", ".vscode/", "coverage/", "*.min.js", "*.min.css", "*.map",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "ios/Pods/", "android/build/", "android/.gradle/", ".gradle/", "*.egg-info/",
    "bower_components/", "third_party/", "Pods/", "ClientSideAssets/", "wp-content/plugins/", "**/app/plugins/",
]
SECTIONS = {name: kind for kind in ("phrase", "rule", "path", "selector", "fingerprint") for name in (kind, f"{kind}s")}


def ignore_regex(patterns: list[str]) -> str:
    """One pattern for a list of globs: `x/` is a folder at any depth, a name without / matches at any depth, **/ is any folders."""
    parts = []
    for p in patterns:
        p = p.removeprefix("**/")
        if p.endswith("/"):
            parts.append(f"(?:^|/){_glob(p[:-1])}/")
        elif "/" in p:
            parts.append(f"(?:^|/){_glob(p.lstrip('/'))}(?:/|$)")
        else:
            parts.append(f"(?:^|/){_glob(p)}(?:/|$)")
    return "|".join(parts) or r"(?!)"


def _glob(p: str) -> str:
    inner = fnmatch.translate(p)
    return re.sub(r"^\(\?s:|\)\\[zZ]$", "", inner).replace(".*", "[^/]*")


def is_locale_file(path: Column) -> Column:
    """JSON or YAML in a folder of translations, or named by a language tag."""
    folders = "|".join(LOCALE_FOLDERS)
    return path.rlike(r"(?i)\.(json|ya?ml)$") & (path.rlike(rf"(?i)(?:^|/)(?:{folders})/") | path.rlike(r"(?:^|/)[a-z]{2,3}(?:[-_][A-Za-z]{2,4})?\.[A-Za-z]+$"))


def _rules(rel: Column, extensions: list[str], ignore: list[str] | None) -> Column:
    suffix = F.lower(F.regexp_extract(rel, r"(\.[^./]*)$", 1))
    return (suffix.isin([e.lower() for e in extensions]) | is_locale_file(rel)) & ~rel.rlike(ignore_regex([*IGNORED, *(ignore or [])]))


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.regexp_replace(path, "^.*?" + re.escape(re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", base)), "")


def list_files(spark: SparkSession, root: str, extensions: list[str], ignore: list[str] | None = None) -> DataFrame:
    """(path, bytes, wanted) of all files under root, from the listing alone: no content is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    rel = _relative(F.col("path"), root)
    return files.select(rel.alias("path"), F.col("length").alias("bytes"), _rules(rel, extensions, ignore).alias("wanted"))


def scan_files(spark: SparkSession, root: str, extensions: list[str], ignore: list[str] | None = None, max_files: int = 0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, text, error) of the files under root; 0 files: without limit, else the first by path.

    Extension, ignore and size rules act on the files' metadata, so the plan opens no file that they exclude; a limit is
    the path of the last file that counts, found in the listing. Files over max_bytes and files that aren't UTF-8 are error
    rows. Locale files count whatever the extension.
    """
    listed = list_files(spark, root, extensions, ignore).filter("wanted")
    uri, size = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), F.col("_metadata.file_size")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    chosen = files.filter(_rules(_relative(uri, root), extensions, ignore) & (size <= max_bytes))
    if max_files:
        last = listed.select("path").orderBy("path").offset(max_files - 1).limit(1).collect()
        if last:
            listed, chosen = listed.filter(F.col("path") <= last[0].path), chosen.filter(_relative(uri, root) <= last[0].path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    read = chosen.select(_relative(F.col("path"), root).alias("path"), text.alias("text")).withColumn("error", F.when(F.col("text").isNull(), "not UTF-8"))
    large = listed.filter(F.col("bytes") > max_bytes).select("path", F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    return read.unionByName(large)


def _one_file(spark: SparkSession, path: str, name: str, max_bytes: int) -> DataFrame:
    file = spark.read.format("binaryFile").load(path).select(F.when(F.col("length") <= max_bytes, F.col("content").cast("string")).alias("t"), "length")
    text = F.when(F.is_valid_utf8("t"), F.col("t"))
    return file.select(F.lit(name).alias("path"), text.alias("text"), F.when(F.col("length") > max_bytes, "too large").when(text.isNull(), "not UTF-8").alias("error"))


def collect_files(spark: SparkSession, paths: list[str], extensions: list[str], ignore: list[str] | None = None, max_files: int = 0, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, list[str]]:
    """((root, path, text, error) of what the paths name, paths that don't exist).

    A folder is scanned by the rules; a file that is named itself is read whatever they say, but for its size. The paths
    are the user's own few; a missing one is named instead of making the scan look clean.
    """
    conf, out, missing = spark.sparkContext._jsc.hadoopConfiguration(), None, []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            missing.append(path)
            continue
        if fs.getFileStatus(p).isDirectory():
            found = scan_files(spark, path, extensions, ignore, max_files, max_bytes)
        else:
            found = _one_file(spark, path, p.getName(), max_bytes)
        found = found.select(F.lit(path).alias("root"), "path", "text", "error")
        out = found if out is None else out.unionByName(found)
    return (spark.createDataFrame([], "root string, path string, text string, error string") if out is None else out), missing


def parse_suppressions(lines: DataFrame) -> DataFrame:
    """(kind, value) of lines (file, nth, line): sections in brackets, one entry a line, # for comments.

    Lines before any section are phrases; an unknown section leaves the one before in force. Equal entries count once.
    """
    known = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    trimmed = lines.withColumn("t", F.trim("line")).filter("t <> '' AND NOT startswith(t, '#')")
    name = F.when(F.col("t").rlike(r"^\[[^\]]+\]$"), F.lower(F.trim(F.regexp_extract("t", r"^\[([^\]]+)\]$", 1))))
    marked = trimmed.withColumn("_section", name).withColumn("kind", F.coalesce(F.last(F.try_element_at(known, F.col("_section")), ignorenulls=True).over(W.partitionBy("file").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)), F.lit("phrase")))
    return marked.filter("_section IS NULL").groupBy("kind", F.col("t").alias("value")).agg(F.min(F.struct("file", "nth")).alias("first")).orderBy("kind", "first").select("kind", "value")


def read_suppressions(spark: SparkSession, *paths: str) -> DataFrame:
    """The lists of several files as one."""
    out = None
    for k, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True).select(F.lit(k).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("nth", "line"))
        out = text if out is None else out.unionByName(text)
    return parse_suppressions(out)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, language, source, register) of JSON lines; blank lines are passed over."""
    return spark.read.schema("text string, label string, language string, source string, register string").json(path).filter("text IS NOT NULL")
