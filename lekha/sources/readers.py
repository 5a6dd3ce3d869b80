"""Readers: JSON with junk around it, nested QA files, shards by glob, listings, checkpoints, chunk streams."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import basename, dirname, strip

MESSAGES = "array<struct<id:string,messages:array<struct<role:string,content:string>>>>"
QA = "data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
CHUNK = "request_id string, seq int, text string, unit string, error_code int"


def json_array(spark: SparkSession, path: str, element: str = MESSAGES) -> DataFrame:
    """Rows of one JSON array with anything before its first and after its last bracket; ``pos`` is the place.

    A file without such a pair of brackets is an error.
    """
    text = spark.read.text(path, wholetext=True)
    v = F.col("value")
    first, last = F.instr(v, "["), F.length(v) - F.instr(F.reverse(v), "]") + 1
    body = F.when((first > 0) & (F.instr(v, "]") > 0) & (last > first), v.substr(first, last - first + 1)).otherwise(F.raise_error(F.lit("no JSON array found")))
    return text.select(F.posexplode(F.from_json(body, element)).alias("pos", "row")).select("pos", "row.*")


def strict_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array; malformed text is an error."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def hub_mirror(spark: SparkSession, root: str, config: str, split: str, kind: str = "parquet") -> DataFrame:
    """A dataset's split from a local mirror laid out as root/config/split."""
    return spark.read.format(kind).load(f"{root.rstrip('/')}/{config}/{split}")


def nested_qa(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(pos, id, context, question, answers) of a nested QA file, flattened in order."""
    rows = spark.read.option("multiLine", True).schema(QA).json(path).select(F.posexplode("data").alias("a", "article"))
    rows = rows.select("a", F.posexplode("article.paragraphs").alias("p", "paragraph"))
    rows = rows.select("a", "p", strip("paragraph.context").alias("context"), F.posexplode("paragraph.qas").alias("q", "qa"))
    out = rows.select("a", "p", "q", "qa.id", "context", strip("qa.question").alias("question"), F.transform("qa.answers", lambda x: strip(x["text"])).alias("answers")).orderBy("a", "p", "q")
    return out.limit(limit) if limit is not None else out


def match_shards(files: list[str], patterns: list[str], prefix: str = "") -> list[str]:
    """Unique sorted files that match; the prefix is added to patterns that lack it. No match is an error."""
    head = f"{prefix.strip('/')}/" if prefix.strip("/") else ""
    full = [p if p.startswith(head) else head + p for p in patterns]
    found = sorted({f for p in full for f in files if fnmatch.fnmatch(f, p)})
    if not found:
        raise FileNotFoundError(f"no file matches {full}")
    return found


def shard_url(repo: str, path: str, kind: str = "dataset") -> str:
    """Address of a dataset repository's file; other kinds of repository are an error."""
    if kind != "dataset":
        raise ValueError("only dataset repositories hold shards")
    return f"hf://datasets/{repo}/{path}"


def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of files; contents are never read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return read.load(root).select("path", "modificationTime", "length")


def parquet_shards(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """The parquet files under root whose paths relative to it match; the listing is a handful of names."""
    base = root.rstrip("/")
    names = [r.path for r in list_files(spark, base, "*.parquet").select("path").collect()]
    at = re.compile(re.escape(base.split(":")[-1]) + "/")
    relative = {at.split(n, maxsplit=1)[-1]: n for n in names}
    return spark.read.parquet(*[relative[f] for f in match_shards(list(relative), patterns)])


def audio_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, content) of audio files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "content")


def newest_json(files: DataFrame) -> DataFrame:
    """One row (path): the newest JSON file whose name doesn't speak of samples."""
    own = files.where(basename("path").endswith(".json") & ~F.contains(F.lower(basename("path")), F.lit("samples")))
    return own.agg(F.max(F.struct("modificationTime", "path"))["path"].alias("path"))


#: Files that mark a checkpoint folder.
CHECKPOINT_MARKERS = ("adapter_model.safetensors", "speech_projector.safetensors", "trainable.safetensors")


def checkpoint_folders(files: DataFrame, markers: tuple[str, ...] = CHECKPOINT_MARKERS) -> DataFrame:
    """(path) of folders that hold a marker file."""
    return files.where(basename("path").isin(*markers)).select(dirname("path").alias("path")).distinct()


def checkpoint_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, epoch, global_step, val_loss, train_loss_epoch) from metadata files; unreadable ones give nulls."""
    schema = "epoch int, global_step long, val_loss double, train_loss_epoch double"
    text = spark.read.text(paths, wholetext=True).select(dirname(F.col("_metadata.file_path")).alias("path"), F.from_json("value", schema).alias("m"))
    return text.select("path", "m.*")


def adapter_base(spark: SparkSession, path: str) -> DataFrame:
    """(path, base_model) of adapter configurations."""
    rows = spark.read.option("multiLine", True).schema("base_model_name_or_path string").json(path)
    return rows.select(dirname(F.col("_metadata.file_path")).alias("path"), F.col("base_model_name_or_path").alias("base_model"))


def nul_chunks(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """JSON records that end in NUL; line ends inside stay."""
    return spark.read.option("lineSep", "\0").schema(schema).json(path)


def load_config(text: str, interpolate: bool = True) -> dict:
    """A configuration tree from JSON or YAML text (YAML where the library is there), ``${a.b}`` resolved."""
    try:
        tree = json.loads(text)
    except ValueError:
        try:
            import yaml

            tree = yaml.safe_load(text)
        except ImportError:
            tree = _plain_yaml(text)
    return _resolved(tree, tree) if interpolate else tree


def _plain_yaml(text: str) -> dict:
    """Nested mappings of scalars and flow-free lists by indentation: what configurations here consist of."""
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    lines = [x.split(" #")[0].rstrip() for x in text.splitlines()]
    lines = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    for k, line in enumerate(lines):
        depth, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= depth:
            stack.pop()
        holder = stack[-1][1]
        if body.startswith("- "):
            holder.append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        if value.strip():
            holder[key] = _scalar(value)
            continue
        after = lines[k + 1] if k + 1 < len(lines) else ""
        inner = len(after) - len(after.lstrip())
        listed = after.strip().startswith("- ") and inner >= depth
        holder[key] = [] if listed else {} if inner > depth else None
        if holder[key] is not None:
            stack.append((depth - 1 if listed and inner == depth else depth, holder[key]))
    return root


def _scalar(text: str):
    text = text.strip()
    words = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in words:
        return words[text.lower()]
    if text[0] in "'\"" and text[-1] == text[0]:
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",")] if text[1:-1].strip() else []
    return text


def _resolved(node, root):
    if isinstance(node, dict):
        return {k: _resolved(v, root) for k, v in node.items()}
    if isinstance(node, list):
        return [_resolved(v, root) for v in node]
    if not isinstance(node, str):
        return node

    def value(path: str):
        at = root
        for part in path.split("."):
            at = at[part]
        return _resolved(at, root)

    whole = re.fullmatch(r"\$\{([^}:]+)\}", node)
    return value(whole[1]) if whole else re.sub(r"\$\{([^}:]+)\}", lambda m: str(value(m[1])), node)


class PagedRows(DataSource):
    """Rows of a paged endpoint as a table, one partition a page.

    Options: ``total`` rows, ``page`` size (100), ``limit``, and ``root``, a folder of page files
    <offset>.json of the form {"rows": [{"row": {...}}], "num_rows_total": n} that stands for the endpoint.
    Pages beyond the limit or the total are never planned; an empty page gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "idx int, question string, answer string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(schema, self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields]
        self.root, self.page = options["root"], int(options.get("page", 100))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.total = int(options["total"])

    def partitions(self) -> list[InputPartition]:
        end = self.total if self.limit is None else min(self.total, self.limit)
        return [InputPartition(offset) for offset in range(0, end, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset = partition.value
        with open(PurePosixPath(self.root) / f"{offset}.json", encoding="utf-8") as file:
            rows = json.load(file)["rows"]
        for k, item in enumerate(rows):
            if self.limit is not None and offset + k >= self.limit:
                return
            row = {"idx": offset + k, **item["row"]}
            yield tuple(row.get(f) for f in self.fields)
