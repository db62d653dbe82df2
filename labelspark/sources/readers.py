"""Reading annotated corpora, generated records, split tables, class maps and result files."""

import csv
from urllib.parse import unquote, urlsplit

from pyspark.sql import functions as F, types as T

from labelspark.operators.lookup import union_all
from labelspark.operators.ranks import fill_down

# Field names of the annotation files.
ANNOTATION_JSON = (
    "comment_id string, content string, found_manipulation string, annotations array<struct<technique:string>>"
)
GENERATED_JSON = "array<map<string,string>>"


def _csv(spark, paths, schema, sep):
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("enforceSchema", False)
        .csv(paths)
    )


def header_lines(spark, paths):
    """{path: first line} of all files by one job: the first line of a file is the first row of its first block."""
    rows = spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0)
    rows = rows.select(F.col("_metadata.file_path").alias("f"), "value", F.monotonically_increasing_id().alias("k"))
    found = {unquote(urlsplit(r["f"]).path): r["line"] for r in rows.groupBy("f").agg(F.min_by("value", "k").alias("line")).collect()}
    lines = {}
    for path in paths:
        plain = urlsplit(path).path.rstrip("/") if "://" in path else path.rstrip("/")
        own = sorted(f for f in found if f == plain or f.startswith(f"{plain}/"))
        if own:
            lines[path] = found[own[0]]
    return lines


def _by_header(spark, paths, sep):
    """[(all-text schema, paths)]: files with the same header line are one scan.

    A file is asked by itself only if its header is not one line: quoted line breaks, or a path the listing names otherwise.
    """
    groups, lines = {}, header_lines(spark, paths)
    for path in paths:
        line = lines.get(path)
        if line is None or line.count('"') % 2:
            head = spark.read.option("header", True).option("sep", sep).option("multiLine", True).csv(path).columns
        else:
            head = next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep, quotechar='"'), [])
        groups.setdefault(tuple(head), []).append(path)
    return [(T.StructType([T.StructField(c, T.StringType()) for c in head]), group) for head, group in groups.items()]


def read_annotated_csv(spark, path, columns=("Comment", "Target"), label=None, sep=";"):
    """Delimited file with a header; the named columns, and `Value` = `label` when one is given."""
    (schema, paths), = _by_header(spark, [path], sep)
    rows = _csv(spark, paths, schema, sep).select(*[F.col(f"`{c}`") for c in columns])
    return rows if label is None else rows.withColumn("Value", F.lit(label))


def file_name():
    """Name of the file or of the directory of part files a row comes from, percent-decoded."""
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    last = F.element_at(parts, -1)
    return F.when(F.startswith(last, F.lit("part-")), F.element_at(parts, -2)).otherwise(last)


def _tagged_files(spark, folder, files, sep, level):
    tags = F.create_map(
        *[x for name, label, group in files for x in (F.lit(name), F.struct(F.lit(label).alias("l"), F.lit(group).alias("g")))]
    )
    frames = []
    for schema, paths in _by_header(spark, [f"{folder}/{name}" for name, _, _ in files], sep):
        cell = F.col(f"`{level}`") if level in schema.names else F.lit(None).cast("string")
        rows = _csv(spark, paths, schema, sep)
        frames.append(
            rows.select(F.col("Comment").alias("text"), F.col("Target").alias("target"), cell.alias("level"), tags[file_name()].alias("_t"))
        )
    rows = union_all(frames)
    return rows.select("text", "target", F.col("_t.l").alias("value"), F.col("_t.g").alias("group"), "level")


def read_file_list(spark, folder, files, sep=";"):
    """[(file, label, group)] as text, target, value and the group of the file; other columns are not read."""
    return _tagged_files(spark, folder, files, sep, None).drop("level")


def read_levels_csv(spark, folder, files, sep=";", level="HS Level"):
    """The same files with the severity column of those with label 1; others have a null level."""
    rows = _tagged_files(spark, folder, files, sep, level)
    return rows.withColumn("level", F.when(F.col("value") == 1, F.col("level")))


def read_plain_csv(spark, path, schema):
    """Comma-separated file with a header; quoted cells may hold line breaks."""
    return _csv(spark, path, schema, ",")


def read_annotation_json(spark, path, schema=ANNOTATION_JSON):
    """JSON array of comments with a nested annotation list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_table(spark, path):
    return spark.read.parquet(path)


def read_generated_json(spark, path):
    """Generated records of many files, each a JSON array of one generator batch.

    Every record becomes a map, so that field names in upper and lower case can be settled afterwards.
    """
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", GENERATED_JSON)).alias("record"))


def load_complete(spark, path):
    """All splits together; task and split names stay text, also where they look like numbers."""
    found = spark.read.parquet(path).schema
    names = [T.StructField(f.name, T.StringType()) if f.name in ("task", "split") else f for f in found]
    return spark.read.schema(T.StructType(names)).parquet(path)


def load_all_tasks(spark, path, split):
    """Every task's rows of one split; only that split's directories are opened."""
    return load_complete(spark, path).where(F.col("split") == split)


def load_task_split(spark, path, task, split):
    """One split of one task; None, with a note, when the table or the task is missing."""
    try:
        rows = load_all_tasks(spark, path, split).where(F.col("task") == task)
        if not rows.isEmpty():
            return rows
        reason = "no such task or split"
    except Exception as exc:
        reason = str(exc).split("\n")[0]
    print(f"cannot load {task}/{split} from {path}: {reason}")
    return None


def load_class_maps(spark, path):
    return spark.read.parquet(path)


def read_report(spark, path, numbers, repeated, sep=";"):
    """Result files: decimal commas become numbers, a blank cell of `repeated` takes the cell above.

    Cells are filled inside their file. A line's position is the first byte of its range plus its place among the rows of its
    task: a line has a byte at least, so ranges of a file stay in order however the scan packs them.
    """
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    line = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = raw.select("*", F.col("_metadata.file_path").alias("_f"), line.alias("_line"))
    cells = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in header]
    filled = fill_down(lines.select(*cells, "_f", "_line"), ["_f"], "_line", list(repeated))
    return filled.select(*[_decimal(c) if c in numbers else F.col(f"`{c}`") for c in header])


def _decimal(c):
    return F.replace(F.col(f"`{c}`"), F.lit(","), F.lit(".")).try_cast("double").alias(c)
