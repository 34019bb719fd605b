"""Readers with explicit schemas and the checks that inputs must pass."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.functions import text as T


class InputError(ValueError):
    """An input file does not hold what it must."""


def raw_papers(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers, malformed ones) of a folder with a JSON object per file, or per line; `limit` takes the first files by name, 0 or None all."""
    rows = spark.read.schema(schemas.RAW_PAPER).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.input_file_name())
    if limit:
        files = rows.select("file").distinct().orderBy("file").limit(limit)
        rows = rows.join(F.broadcast(files), "file", "left_semi")
    bad = F.col("_bad").isNotNull() | F.col("paper_id").isNull()
    return rows.where(~bad).drop("_bad"), rows.where(bad).select("file", "_bad")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, label of a JSON list; ids may be numbers. Missing fields, double ids and files without a list are errors."""
    text = spark.read.text(path, wholetext=True)
    if text.where(~F.ltrim("value").startswith("[")).limit(1).count():
        raise InputError("a query file is a JSON list")
    rows = text.select(F.explode(F.from_json("value", "array<struct<query_id:string,query:string,label:string>>")).alias("q")).select("q.*")
    if rows.where("query_id is null or query is null").limit(1).count():
        raise InputError("a query lacks query_id or query")
    twice = rows.groupBy("query_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise InputError(f"query id {twice[0]['query_id']} occurs twice")
    return rows


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    if parts.where(F.size("p") != n).limit(1).count():
        raise InputError(f"a line has not {n} fields")
    return parts


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade of white-space separated lines; of a pair judged twice, the larger grade."""
    p = _fields(spark, path, 4).select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("grade"))
    return p.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, rank, score, run_id."""
    c = F.col("p")
    return _fields(spark, path, 6).select(c[0].alias("query_id"), c[2].alias("doc_id"), c[3].cast("int").alias("rank"), c[4].cast("double").alias("score"), c[5].alias("run_id"))


def texts_of(collection: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """doc_id, text of the wanted ids; an id that is missing is an error."""
    rows = collection.select("doc_id", "text")
    if ids is None:
        return rows
    wanted = ids.select("doc_id").distinct()
    missing = wanted.join(rows, "doc_id", "left_anti").limit(1).collect()
    if missing:
        raise InputError(f"no text for {missing[0]['doc_id']}")
    return rows.join(wanted, "doc_id", "left_semi")


def tuning_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TUNING_GRID).option("header", True).csv(path)


def grid_matrix(grid: DataFrame, value: str) -> DataFrame:
    """k1 and a column per b; cells that were not tried are null."""
    return grid.groupBy("k1").pivot("b").agg(F.first(value)).orderBy("k1")


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path whose name ends in the largest number."""
    n = F.regexp_extract("path", r"-(\d+)$", 1)
    return paths.where(n != "").orderBy(n.cast("long").desc()).limit(1)


def batches(rows: DataFrame, size: int = 256, limit: int | None = None, order: str = "doc_id") -> DataFrame:
    """rows(doc_id, text) with a logical batch number, `size` non-blank texts each, in order. A limit of 0 gives none.

    Numbers come from two levels: rows per range partition, then inside each.
    """
    from rankloom.operators.index import ranged

    if size < 1:
        raise ValueError("a batch has one row at least")
    rows = rows.where(F.trim("text") != "")
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    parted, base = ranged(rows, order)
    numbered = parted.join(F.broadcast(base), "__p")
    return numbered.withColumn("batch", F.floor((F.col("__base") + F.col("__i")) / size)).drop("__p", "__i", "__base")


def saved_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(weights, settings) that writers.save_sparse stored."""
    return spark.read.schema("term string, doc_id string, weight double").parquet(f"{path}/weights"), settings(spark, path)


def saved_dense(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(vectors, settings) that writers.save_dense stored."""
    return spark.read.parquet(f"{path}/vectors"), settings(spark, path)


def settings(spark: SparkSession, path: str) -> dict:
    return {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(f"{path}/settings").collect()}


def load_or_build(spark: SparkSession, path: str, load, build, force: bool = False):
    """load(spark, path), after build() has stored it there if nothing is, or if it must be made again."""
    from pyspark.errors import AnalysisException

    if not force:
        try:
            return load(spark, path)
        except AnalysisException:
            pass
    build()
    return load(spark, path)


def config(spark: SparkSession, path: str) -> dict:
    """A YAML file of settings, as a dictionary; an empty file has none. Read by Spark, so that it can lie in any store."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:
        found = plain_settings(text)
    else:
        found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise InputError(f"{path} has no settings by name")
    return found


def plain_settings(text: str) -> dict:
    """The part of YAML that settings files use: names by indentation, one-line lists, quoted and plain scalars, comments."""

    def scalar(x: str):
        if x[:1] in "'\"" and len(x) > 1:
            return x[1:-1]
        if x.startswith("["):
            return [scalar(y.strip()) for y in x.strip("[]").split(",") if y.strip()]
        known = {"true": True, "false": False, "null": None, "": None}
        if x in known:
            return known[x]
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x

    out: dict = {}
    open_: list[tuple[int, dict]] = [(-1, out)]
    for line in text.split("\n"):
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        name, colon, value = line.strip().partition(":")
        if not colon:
            raise InputError(f"not a setting: {line.strip()}")
        while open_[-1][0] >= depth:
            open_.pop()
        if value.strip():
            open_[-1][1][name] = scalar(value.strip())
        else:
            inner: dict = {}
            open_[-1][1][name] = inner
            open_.append((depth, inner))
    return out


def preprocessing(spark: SparkSession, path: str) -> tuple[T.Cleaning, T.Tokenizing]:
    """(cleaning, tokenizing) of a file with the sections cleaning and tokenizer; unknown keys are errors. Words of a custom file come in."""
    found = config(spark, path)
    T.known_sections(found, ("cleaning", "tokenizer"))
    section = dict(found.get("tokenizer") or {})
    words = dict(section.get("stopwords") or {})
    if "stopwords" in section:
        custom = stopword_file(spark, words["custom_file"]) if words.get("source") == "custom" else None
        section["stopwords"] = {"source": {"nltk": "english"}.get(words.get("source"), words.get("source", "english")), "extra": words.get("extra"), "keep": words.get("keep"), "custom": custom}
    return T.Cleaning.of(found.get("cleaning") or {}), T.Tokenizing.of(section)


def bm25_settings(spark: SparkSession, path: str, collection: str) -> tuple[float, float]:
    """(k1, b) of a collection; an error if the file has none."""
    found = config(spark, path).get(collection)
    try:
        return float(found["k1"]), float(found["b"])
    except (KeyError, TypeError):
        raise InputError(f"{path} has no k1 and b of {collection}") from None


def run_parts(model: str) -> list[str]:
    """The runs that a model is made of: rrf:a+b of a and b."""
    return model.removeprefix("rrf:").split("+") if model.startswith("rrf:") else [model]


def run_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """collection, model, query_set, path of the run files in a folder, by their names <collection>_<model>_<query set>."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for f in fs.listStatus(at) if fs.exists(at) else []:
        parts = re.fullmatch(r"(paper|paragraph)_(.+)_(train|study|test)(?:\.\w+)?", f.getPath().getName())
        if parts:
            rows.append((*parts.groups(), f.getPath().toString()))
    return spark.createDataFrame(rows, "collection string, model string, query_set string, path string")


def available_models(catalogue: DataFrame, models: list[str], collection: str, query_set: str) -> tuple[list[str], dict[str, list[str]]]:
    """(models whose runs are all there, the missing runs of the others)."""
    known = {r["model"] for r in catalogue.where((F.col("collection") == collection) & (F.col("query_set") == query_set)).collect()}
    missing = {m: [p for p in run_parts(m) if p not in known] for m in models}
    return [m for m in models if not missing[m]], {m: p for m, p in missing.items() if p}


def load_run(catalogue: DataFrame, model: str, collection: str, query_set: str) -> DataFrame:
    """query_id, doc_id, score, rank of a model's run, or of the fusion of those that rrf:a+b names."""
    from rankloom.operators import ranking

    found = available_models(catalogue, [model], collection, query_set)[1]
    if found:
        raise InputError(f"no run of {', '.join(found[model])}")
    wanted = catalogue.where((F.col("collection") == collection) & (F.col("query_set") == query_set))
    paths = {r["model"]: r["path"] for r in wanted.collect()}
    runs = [run(catalogue.sparkSession, paths[p]).select("query_id", "doc_id", "score", "rank") for p in run_parts(model)]
    return ranking.rrf(runs) if model.startswith("rrf:") else runs[0]


def manifest_count(spark: SparkSession, path: str, name: str = "paragraphs") -> int | None:
    """A count of a manifest, alone or within its counts, or None without one."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.json(path).first()
    except AnalysisException:
        return None
    found = row.asDict(True) if row else {}
    return found.get(name, (found.get("counts") or {}).get(name))


def stopword_file(spark: SparkSession, path: str) -> list[str]:
    """Lower-cased words of a file with one per line; blank lines are skipped."""
    return [r[0] for r in spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct().orderBy("w").collect()]
