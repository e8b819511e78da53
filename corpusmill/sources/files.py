"""Files in and out: predictions, datasets by split, labelled folders, binary files, incremental stores."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.metrics import check_alignment
from .places import file_system

PREDICTIONS = "id string, label int, word_count long, source string, generator_model string, pred int, p_human double, p_ai_generated double, p_ai_assisted double"


def read_predictions(spark: SparkSession, paths: dict[str, str], check: bool = True) -> DataFrame:
    """A long table of the CSV files of several models; raises if ids or labels do not line up."""
    out = None
    for model, path in paths.items():
        one = spark.read.csv(path, header=True, schema=PREDICTIONS).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    out = out.select("id", "model", "label", "pred", *[F.col(c).alias(f"p{k}") for k, c in enumerate(("p_human", "p_ai_generated", "p_ai_assisted"))], "word_count", "source", F.coalesce("generator_model", F.lit("none")).alias("generator_model"))
    if check and (bad := check_alignment(out).limit(5).collect()):
        raise ValueError(f"{bad[0]['problem']}, e.g. {[r['id'] for r in bad]}")
    return out


def read_dataset(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """A dataset stored by split; all splits must be there."""
    df = spark.read.parquet(path)
    have = {r["split"] for r in df.select("split").distinct().collect()}
    if missing := set(splits) - have:
        raise ValueError(f"splits missing: {sorted(missing)}")
    return df


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_folder(spark: SparkSession, path: str, labels: dict[str, int], default: int = 0) -> DataFrame:
    """(file, label, text) of text files, labelled by the folder they lie in."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), folder), F.lit(default))
    return df.select(F.col("_metadata.file_name").alias("file"), label.alias("label"), F.col("value").alias("text"))


def read_parts(spark: SparkSession, path: str, together: int = 1000) -> DataFrame:
    """(file, text) of what the sink of one file per row wrote in its layout of parts. The driver lists the
    parts; a task lists and reads the files of one, so that neither knows millions of them."""
    from pyarrow.fs import FileSelector, FileType

    listed, root = file_system(path)
    parts = [f.path for f in listed.get_file_info(FileSelector(root)) if f.type == FileType.Directory and f.base_name.startswith("part-")]

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        files = file_system(path)[0]
        for folder in (f for r in rows for f in r["folder"].to_pylist()):
            names, texts, held = [], [], 0
            for f in files.get_file_info(FileSelector(folder)):
                with files.open_input_stream(f.path) as stream:
                    texts.append(stream.read())
                names.append(f.base_name)
                held += len(texts[-1])
                if len(names) >= together or held > 1 << 22:
                    yield pa.RecordBatch.from_pydict({"file": names, "text": pa.array(texts, pa.binary()).cast(pa.string())})
                    names, texts, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_pydict({"file": names, "text": pa.array(texts, pa.binary()).cast(pa.string())})

    one_each = spark.sparkContext.parallelize([(p,) for p in parts], max(1, len(parts)))
    return spark.createDataFrame(one_each, "folder string").mapInArrow(read, "file string, text string")


def read_binary(spark: SparkSession, path: str, most_bytes: int, magic: str = "%PDF") -> DataFrame:
    """Files with a reason to skip: too large, or not of the kind that `magic` begins. The size
    filter is on file metadata; large files are not read."""
    df = spark.read.format("binaryFile").load(path)
    head = F.decode(F.substring("content", 1, len(magic)), "ISO-8859-1")
    why = F.when(F.col("length") > most_bytes, "pdf_too_large").when(head != magic, "pdf_not_a_pdf")
    return df.select("path", "length", why.alias("skip_reason"), F.when(why.isNull(), F.col("content")).alias("content"))


def append_new(rows: DataFrame, path: str, on: list[str]) -> int:
    """Appends the rows whose key the store lacks and tells how many: an idempotent resume."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select(*on).distinct(), on, "left_anti")
    rows = rows.dropDuplicates(on).cache()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def store_summary(df: DataFrame) -> DataFrame:
    """Rows by source and split, with totals."""
    return df.cube("source", "split").agg(F.count(F.lit(1)).alias("n"))


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_array(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The elements of an array field of a JSON document."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("x")).select("x.*")


def card(counts: DataFrame, template: str) -> str:
    """A dataset card: {rows} in the template becomes a table of the counts."""
    cols = counts.columns
    lines = [" | ".join(cols), " | ".join("---" for _ in cols), *[" | ".join(str(r[c]) for c in cols) for r in counts.collect()]]
    return template.replace("{rows}", "\n".join(lines))


def _whole_keys(value):
    """Mappings whose keys are all numbers, as in the labels of a JSON file, get whole ones."""
    if isinstance(value, dict):
        numbers = value and all(str(k).lstrip("-").isdigit() for k in value)
        return {int(k) if numbers else k: _whole_keys(v) for k, v in value.items()}
    return [_whole_keys(v) for v in value] if isinstance(value, list) else value


def load_config(path: str, sections: tuple[str, ...]) -> dict:
    """A JSON or YAML configuration; all sections must be there. Labels have whole numbers as keys."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML configurations need the yaml package; JSON ones do not") from e
        config = yaml.safe_load(text) or {}
    else:
        config = json.loads(text)
    if missing := [s for s in sections if s not in config]:
        raise ValueError(f"sections missing: {missing}")
    return _whole_keys(config)


def load_temperature(path: str) -> float:
    """The temperature of a detector's configuration: 1 if there is none; it must be above 0."""
    p = Path(path)
    value = float(json.loads(p.read_text(encoding="utf-8")).get("temperature", 1.0)) if p.exists() else 1.0
    if value <= 0:
        raise ValueError(f"invalid temperature: {value}")
    return value


def one_of(name: str, known: tuple[str, ...] | list[str]) -> str:
    if name not in known:
        raise ValueError(f"unknown {name!r}; known: {', '.join(known)}")
    return name


def external_check(rows: DataFrame) -> DataFrame:
    """Counts of true label by a detector's answer."""
    return rows.groupBy("true_label").pivot("prediction").count().na.fill(0)


def word_lengths(df: DataFrame) -> DataFrame:
    return df.withColumn("word_count", T.word_count(F.col("text")))


SPANS = "doc_id string, page int, block int, line int, span int, text string, size double, bold boolean, x0 double, x1 double"


def pdf_spans(binary: DataFrame, open_pdf) -> DataFrame:
    """The spans of each file as `layout` takes them. `open_pdf(bytes)` gives pages of blocks of lines
    of (text, size, bold, x0, x1); no PDF library is at hand here, so it is a plug-in. Files that it
    cannot read give no rows. Sizes are rounded to halves and blank spans dropped."""
    import pandas as pd

    def run(parts):
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    pages = open_pdf(bytes(content)) if content is not None else []
                except Exception:  # noqa: BLE001  an unreadable file is a file without spans
                    pages = []
                rows += [(path, i, j, k, m, t, round(size * 2) / 2, bool(bold), float(x0), float(x1)) for i, blocks in enumerate(pages) for j, lines in enumerate(blocks) for k, spans in enumerate(lines) for m, (t, size, bold, x0, x1) in enumerate(spans) if t.strip()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    return binary.select("path", "content").mapInPandas(run, SPANS)


def write_config(path: str, **values) -> None:
    """A detector's configuration, written to a new file that then takes the old one's place."""
    target = Path(path)
    new = target.with_suffix(".new")
    new.write_text(json.dumps(values, ensure_ascii=False, indent=1), encoding="utf-8")
    new.replace(target)


def first_files(spark: SparkSession, folders: list[str], pattern: str = "*.txt") -> DataFrame:
    """(id, path, folder, length): of the files of one name in several folders that of the first folder that
    has it; the id is the name without its ending. Only file metadata is read."""
    from functools import reduce

    def of(k: int, folder: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"), F.struct(F.lit(k).alias("folder"), "path", "length").alias("f"))

    found = reduce(DataFrame.unionByName, [of(k, f) for k, f in enumerate(folders)])
    return found.groupBy("id").agg(F.min("f").alias("f")).select("id", "f.path", "f.folder", "f.length")


def texts_of(rows: DataFrame, folders: list[str], id_col: str = "id") -> DataFrame:
    """`rows` with `text` and `text_folder` (its number) from the first folder that has the row's file; null
    where none has. Contents are read for these files alone, after the join."""
    from .places import file_system

    def read(batches):
        for b in batches:
            at = b.schema.get_field_index("_path")
            texts = []
            for path in b.column(at).to_pylist():
                if path is None:
                    texts.append(None)
                    continue
                files, name = file_system(path)
                with files.open_input_stream(name) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array(texts, pa.string())], names=[*[n for n in b.schema.names if n != "_path"], "text"])

    first = first_files(rows.sparkSession, folders).select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("folder").alias("text_folder"))
    joined = rows.join(first, F.col(id_col).cast("string") == F.col("_id"), "left").drop("_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "_path") + ", text string"
    return joined.mapInArrow(read, schema)
