"""Files as a DataFrame: a recursive scan with ignore rules, limits on depth, size and extension, and extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.functions.keywords import keywords
from quarry.plans import folders
from quarry.plans.lineage import bounded_batches
from quarry.plans.settings import Settings
from quarry.sources import formats

#: What extraction yields for a file. error is null if it went well.
DOCUMENT = "path string, content string, title string, language string, keywords string, mime string, error string"
#: The most bytes of a file that is read whole.
MOST_BYTES = 100 << 20
#: Names of ignore files; a later one's rules override an earlier one's of the same folder.
IGNORE_FILES = (".gitignore", ".ignore")
#: Files that are opened by name rather than found by a scan of the whole folder.
FEW_FILES = 10_000


def rule_regex(line: str, folder: str = "") -> tuple[str, bool] | None:
    """A line of an ignore file in a folder: what paths it meets, relative to the root, and whether it takes them out (else it brings
    them back). A slash at the start or within ties a pattern to the folder; one at its end means folders only; # starts a comment, a
    backslash takes the meaning from a first # or !."""
    rule = line.rstrip("\r\n")
    rule = rule if rule.endswith("\\ ") else rule.rstrip()
    if not rule or rule[0] == "#":
        return None
    out = rule[0] != "!"
    rule = rule[not out :]
    rule = rule[1:] if rule[:2] in ("\\#", "\\!") else rule
    tail = "/" if rule.endswith("/") else "(?:/|$)"
    body = rule.rstrip("/")
    if not body:
        return None
    rx = fn.glob_regex(body.lstrip("/")).removeprefix("(?:^|/)").removeprefix("^").removesuffix("(?:/|$)").removesuffix("$")
    base = f"\\Q{folder}/\\E" if folder else ""
    return f"^{base}{rx}{tail}" if "/" in body else f"^{base}(?:.*/)?{rx}{tail}", out


def ignore_rules(spark: SparkSession, root: str, names: list[str], ignore: str = "") -> DataFrame:
    """(folder, place, rule, out): the rules of ignore files (names relative to root), a row a line, in the folder that holds them, and
    those of `ignore` in the root. place orders a folder's rules: the later wins, of .gitignore before .ignore; the global ones come first.
    Spark's file sources pass over names that begin with a dot, so the driver reads these files."""
    rows = [("", i, *made) for i, line in enumerate(ignore.splitlines()) if (made := rule_regex(line))]
    for path in names:
        folder, _, name = path.rpartition("/")
        for i, line in enumerate(folders.content(spark, f"{root.rstrip('/')}/{path}").splitlines()):
            if made := rule_regex(line, folder):
                rows.append((folder, (IGNORE_FILES.index(name) + 1 << 32) + i, *made))
    return spark.createDataFrame(rows, "folder string, place long, rule string, out boolean")


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path, ...) that the rules of the folders above them leave in. Each path meets its ancestors' rules by a join on the folder; of
    those that match the last one of the deepest folder decides, unless a folder above the file is itself taken out, from which
    nothing is brought back."""
    parts = F.split("path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    # the path and its folders, each judged by the rules of the folders above it
    steps = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).select("path", F.when(F.col("n") < F.size(F.split("path", "/")), F.concat(prefix(F.col("n")), F.lit("/"))).otherwise(F.col("path")).alias("step"), "n")
    met = steps.select("path", "step", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("depth")).withColumn("folder", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/"))
    hit = met.join(rules, "folder").where(F.expr("step rlike rule"))
    verdict = hit.groupBy("path", "n").agg(F.max_by("out", F.struct("depth", "place")).alias("out"))
    return files.join(verdict.where("out").select("path").distinct(), "path", "left_anti")


def select_files(files: DataFrame, settings: Settings, allowed: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """files: path (relative to its root), size, ... Drops what patterns, hidden names, depth, extension or size exclude
    (allowed and limit, in bytes, stand in for the settings'). Cheap conditions on columns only, so they run in the scan, before contents are read."""
    p = F.col("path")
    out = files.where(~fn.excluded(p, settings.excludes()))
    if not settings.include_hidden:
        out = out.where(~p.rlike(r"(?:^|/)\.[^/]"))
    out = out.where(F.size(F.split(p, "/")) <= settings.max_depth)
    out = out.where(F.coalesce(fn.extension(p).isin(settings.allowed_extensions() if allowed is None else allowed), F.lit(False)))
    return out.where(F.col("size") <= (settings.size_limit_mb * (1 << 20) if limit is None else limit))


def _listed(raw: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    rel = F.element_at(F.split(F.col("path"), F.lit("\\Q" + base + "\\E"), 2), -1)
    return raw.select(rel.alias("path"), F.col("path").alias("uri"), F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def scan(spark: SparkSession, root: str, settings: Settings | None = None, ignore: str = "") -> DataFrame:
    """(path relative to root, uri, modified epoch seconds, size, content binary) of the regular files below root. The content is
    read only by plans that use it. Ignore files in the tree hold in their folders; `ignore` has rules for all of it, which those
    override."""
    settings = settings or Settings()
    every = _listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root)
    files = select_files(every, settings)
    if not settings.use_gitignore:
        return files
    return without_ignored(files, ignore_rules(spark, root, folders.named(spark, root, IGNORE_FILES, settings.max_depth), ignore))


def contents(spark: SparkSession, files: DataFrame, todo: DataFrame) -> DataFrame:
    """files (with content) of the paths in todo (path, uri). Up to FEW_FILES are opened by name, so the others are not read."""
    few = todo.limit(FEW_FILES + 1).select("uri").collect()
    names = [r["uri"] for r in few]
    if len(names) > FEW_FILES or any(c in n for n in names for c in "*?[]{}\\,"):
        return files.join(todo.select("path"), "path", "left_semi")
    if not names:
        return files.limit(0)
    own = spark.read.format("binaryFile").load(names).select(F.col("path").alias("uri"), F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return own.join(todo.select("path", "uri"), "uri").select("path", "uri", "modified", "size", "content")


def some(spark: SparkSession, root: str, paths: list[str], settings: Settings | None = None, ignore: str = "") -> DataFrame:
    """As scan(), of the files among paths (relative to root) that are there and not excluded."""
    base = root.rstrip("/")
    there = [f"{base}/{p}" for p in paths if folders.exists(spark, f"{base}/{p}")]
    if any(c in n for n in there for c in "*?[]{}\\,"):
        return scan(spark, root, settings, ignore).join(spark.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi")
    if not there:
        return spark.createDataFrame([], "path string, uri string, modified long, size long, content binary")
    settings = settings or Settings()
    files = select_files(_listed(spark.read.format("binaryFile").load(there), root), settings)
    if not settings.use_gitignore:
        return files
    # the ignore files of the folders above
    above = sorted({"/".join(p.split("/")[:i]) for p in paths for i in range(len(p.split("/")))})
    names = [f"{f}/{n}" if f else n for f in above for n in IGNORE_FILES]
    return without_ignored(files, ignore_rules(spark, root, [n for n in names if folders.exists(spark, f"{base}/{n}")], ignore))


def _text(data: bytes) -> tuple[str, str | None]:
    return data.decode("utf-8", "replace"), None


def _markdown(data: bytes) -> tuple[str, str | None]:
    text = data.decode("utf-8", "replace")
    heads = [x.lstrip("#").strip() for x in text.splitlines() if x.startswith("# ")]
    return text, heads[0] if heads else None


def html(data: bytes) -> tuple[str, str | None]:
    import re
    from html import unescape

    raw = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", data.decode("utf-8", "replace"))
    title = re.search(r"(?is)<title[^>]*>(.*?)</title", raw)
    plain = lambda s: " ".join(unescape(re.sub(r"(?s)<[^>]*>", " ", s)).split())
    return plain(raw), plain(title[1]) if title else None


TEXT = "txt csv tsv json xml rs py js ts go java c cpp h hpp cs css log svg".split()
#: Extractors by extension: bytes to (content, title). Formats that need libraries of their own register here.
EXTRACTORS: dict[str, Callable[[bytes], tuple[str, str | None]]] = {
    **dict.fromkeys(TEXT, _text), "md": _markdown, "html": html, "docx": formats.docx, "xlsx": formats.xlsx, "pptx": formats.pptx, "odt": formats.odt, "epub": formats.epub, "eml": formats.mail,
    **{e: formats.listing(f"x.{e}") for e in ("zip", "tar", "gz")},
}


def register(extension: str, extractor: Callable[[bytes], tuple[str, str | None]]) -> None:
    EXTRACTORS[extension.lower().lstrip(".")] = extractor


def expand(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """files (path, uri, modified, size, content) and, after each, what it holds if it is a zip, tar, gz or mail: members under path!/member
    with its time. Members that settings exclude by name, extension or size are left out; a file that cannot be opened, or holds more
    than formats.MOST_BYTES in all, has those that came before."""
    bounded_batches(files.sparkSession, 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf
            for path, uri, modified, data in zip(pdf["path"], pdf["uri"], pdf["modified"], pdf["content"], strict=True):
                held, size = [], 0
                try:
                    for inner, body in formats.members(bytes(data), path):
                        held.append((inner, uri, modified, len(body), body))
                        size += len(body)
                        if size > 8 << 20:
                            yield pd.DataFrame(held, columns=pdf.columns)
                            held, size = [], 0
                except Exception:  # noqa: BLE001  a broken file's own row tells it
                    pass
                if held:
                    yield pd.DataFrame(held, columns=pdf.columns)

    every = files.select("path", "uri", "modified", "size", "content").mapInPandas(run, "path string, uri string, modified long, size long, content binary")
    inside = F.col("path").contains(formats.WITHIN)
    own = Settings() if settings is None else settings
    name = F.element_at(F.split("path", "!/"), -1)
    fits = F.coalesce(fn.extension(name).isin(own.allowed_extensions()), F.lit(False)) & ~fn.excluded(name, own.excludes()) & (F.col("size") <= own.size_limit_mb * (1 << 20))
    return every.where(~inside | fits)


def owner(path: Column) -> Column:
    """The file in which a path lies: itself, or the outermost container."""
    return F.split(path, formats.WITHIN, 2)[0]


def extract(files: DataFrame, extractors: dict[str, Callable] | None = None, language: Callable[[str], str | None] | None = None) -> DataFrame:
    """files: path, content (binary). Each row's document, with content type, keywords and, if there is a guess (language.Guess), language; one that
    fails has its error and no content, and fails no other."""
    table = dict(EXTRACTORS if extractors is None else extractors)
    bounded_batches(files.sparkSession, 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                ext, data = path.rsplit("/", 1)[-1].rpartition(".")[2].lower(), bytes(data)
                kind = formats.content_type(data, ext)
                try:
                    if len(data) > MOST_BYTES:
                        raise ValueError(f"more than {MOST_BYTES} bytes")
                    content, title = table[ext](data)
                    rows.append((path, content, title, language(content) if language else None, " ".join(keywords(content)) or None, kind, None))
                except KeyError as e:
                    rows.append((path, None, None, None, None, kind, f"no extractor for {ext!r}" if ext not in table else f"KeyError: {e}"))
                except Exception as e:  # noqa: BLE001  any extractor's failure is the row's
                    rows.append((path, None, None, None, None, kind, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENT.split(", ")])

    return files.select("path", "content").mapInPandas(run, DOCUMENT)


def extract_distinct(files: DataFrame, extractors: dict[str, Callable] | None = None, language: Callable[[str], str | None] | None = None) -> DataFrame:
    """As extract(), but files of equal content are extracted once, and each gets the result under its own path. A copy of another
    extension than the extracted one's counts as other content."""
    keyed = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("ext", fn.extension(F.col("path")))
    first = keyed.groupBy("content_hash", "ext").agg(F.min("path").alias("first"))
    once = keyed.join(first, (keyed["path"] == first["first"]) & (keyed["content_hash"] == first["content_hash"])).select("path", "content")
    done = extract(once, extractors, language).withColumnRenamed("path", "first")
    owners = keyed.select("path", "modified", "size", "content_hash", "ext").join(first, ["content_hash", "ext"])
    return owners.join(done, "first").select("path", "content", "title", F.col("ext").alias("extension"), "language", "keywords", "mime", "modified", "size", "content_hash", "error")
