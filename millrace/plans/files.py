"""Queries of readers and writers: each writes to the shared folder and reads back."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import validate as V
from ..operators.dedup import shared_folder
from ..sources import readers as R
from ..sources import writers as W
from .catalog import Tables, query

c = F.col
ROW = "id long, variant string, k long, note string"


def _rows(t: Tables):
    return t.records.select("id", "variant", "k", F.lit(None).cast("string").alias("note"))


_ALL = "SELECT id, variant, k, NULL::VARCHAR AS note FROM records"


def _text(t: Tables, lines, name: str = "text") -> str:
    """Lines of text in the shared folder: the written folder."""
    path = f"{shared_folder(t.spark)}/{name}"
    lines.write.text(path)
    return path


def _documents(t: Tables, rows, value, name: str = "text") -> str:
    """JSON documents of a thousand ids each, a file each, in the shared folder."""
    path = f"{shared_folder(t.spark)}/{name}"
    rows.groupBy(F.floor(c("id") / 1000).alias("part")).agg(value.alias("value")).write.partitionBy("part").text(path)
    return path


def _with_noise(t: Tables):
    """JSON lines of rows, with blank, broken and non-object lines among them."""
    good = _rows(t).select("id", F.to_json(F.struct("id", "variant", "k", "note"), {"ignoreNullFields": "false"}).alias("value"))
    bad = good.withColumn("value", F.when(c("id") % 60 == 0, "").when(c("id") % 60 == 20, '{"id": ').otherwise("[1]"))
    return good.unionByName(bad).select("value")


@query("scan.jsonl.lenient", _ALL)
def _(t: Tables):
    blank = _rows(t).select(F.to_json(F.struct("id", "variant", "k")).alias("value")).unionByName(t.spark.range(3).select(F.lit("").alias("value")))
    return R.jsonl(t.spark, _text(t, blank), ROW)


@query("scan.jsonl.strict", f"SELECT 'rows' AS part, count(*) AS n FROM ({_ALL}) UNION ALL SELECT CASE id % 60 WHEN 20 THEN 'not_json' ELSE 'not_an_object' END, count(*) FROM ({_ALL}) WHERE id % 60 > 0 GROUP BY 1")
def _(t: Tables):
    rows, bad = R.jsonl_strict(t.spark, _text(t, _with_noise(t)), ROW)
    return rows.select(F.lit("rows").alias("part")).unionByName(bad.select(c("reason").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query("scan.jsonl.noblank", f"SELECT CASE id % 60 WHEN 0 THEN 'blank' WHEN 20 THEN 'not_json' ELSE 'not_an_object' END AS reason, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def _(t: Tables):
    _, bad = R.jsonl_strict(t.spark, _text(t, _with_noise(t)), ROW, blank_is_bad=True)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("scan.json.doc", "SELECT id, k FROM records")
def _(t: Tables):
    path = _documents(t, t.records, F.to_json(F.collect_list(F.struct("id", "k"))))
    return R.json_document(t.spark, path, "id long, k long").select("id", "k")


@query("scan.json.array.streaming", "SELECT id // 100 AS part, count(*) AS n FROM records GROUP BY 1")
def _(t: Tables):
    """An array split into files of a hundred elements: a task each."""
    docs = t.records.groupBy(F.floor(c("id") / 100).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "k"))).alias("value"))
    path = f"{shared_folder(t.spark)}/arrays"
    docs.write.partitionBy("part").text(path)
    rows = t.spark.read.schema("id long, k long, part long").option("multiLine", True).json(path)
    return rows.groupBy("part").agg(F.count("*").alias("n"))


@query("scan.parquet.batched", "SELECT event_id, value FROM events WHERE value > 100")
def _(t: Tables):
    return R.parquet_columns(t.spark, [f"{t.where}/events.parquet"], ["event_id", "value"]).where("value > 100")


@query("scan.parquet.recursive", "SELECT variant, count(*) AS n FROM records GROUP BY 1")
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/deep"
    t.records.select("id", "variant", "split").write.parquet(f"{path}/a/b")
    return R.parquet_recursive(t.spark, path).groupBy("variant").agg(F.count("*").alias("n"))


def _manifest(t: Tables):
    episodes = F.collect_list(F.struct("id", F.concat(F.lit("pub-"), "variant").alias("variant"), "episode")).alias("episodes")
    doc = F.to_json(F.struct(F.lit("suite-1").alias("schema_id"), F.lit(True).alias("frozen"), episodes))
    names = {f"pub-{v}": v for v in ("view", "click", "error", "signup", "purchase")}
    return R.manifest(t.spark, _documents(t, t.records, doc), "id:bigint,variant:string,episode:bigint", "suite-1", names, parts=True)


@query("scan.manifest", "SELECT id, variant, episode FROM records")
def _(t: Tables):
    return _manifest(t).select("id", "variant", "episode")


@query("scan.manifest.frozen", "SELECT variant, count(*) AS n, true AS frozen FROM records GROUP BY 1")
def _(t: Tables):
    rows = _manifest(t)
    V.require(V.unique_gate(rows, ["id"]).unionByName(V.gate(rows, [("not_frozen", ~c("frozen"))])))
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.bool_and("frozen").alias("frozen"))


def _records(t: Tables):
    status = F.when(c("k") % 4 == 0, "running").otherwise("complete")
    return t.records.select("id", "variant", "k", status.alias("record_status"))


@query("scan.records.dir", "SELECT id, variant FROM records WHERE k % 4 > 0")
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/records"
    _records(t).write.partitionBy("variant").json(path)
    rows = R.complete_records(t.spark, path, "id long, record_status string, variant string")
    return rows.select("id", "variant")


@query("scan.records.shards", "SELECT id, CAST(id % 4 AS INT) AS shard FROM records WHERE k % 4 > 0")
def _(t: Tables):
    path = shared_folder(t.spark)
    for i in range(4):
        _records(t).where(c("id") % 4 == i).write.json(f"{path}/shards/shard_{i}/records")
    return R.shard_records(t.spark, f"{path}/shards/shard_*/records", "id long, record_status string").select("id", "shard")


@query("scan.ids.txt", "SELECT id::VARCHAR AS id FROM records")
def _(t: Tables):
    return R.ids(t.spark, _text(t, t.records.select(c("id").cast("string"))))


@query("scan.mixed", "SELECT id, CASE WHEN id % 3 < 2 THEN k END AS k FROM records")
def _(t: Tables):
    path, rows = shared_folder(t.spark), t.records.select("id", "k")
    rows.where("id % 3 = 0").write.parquet(f"{path}/a.parquet")
    rows.where("id % 3 = 1").write.json(f"{path}/b.jsonl")
    docs = _documents(t, rows.where("id % 3 = 2"), F.to_json(F.collect_list(F.struct("id"))), "c.json")
    return R.mixed(t.spark, [f"{path}/a.parquet", f"{path}/b.jsonl", docs]).select("id", "k")


def _ground(t: Tables):
    return t.boxes.select("id", c("variant").alias("instruction"), "x1", "y1", "x2", "y2", "w", "h")


@query("scan.bench.pro", "SELECT id, x1, y1, x2, y2 FROM boxes")
def _(t: Tables):
    return R.bench_xyxy(_ground(t).withColumn("bbox", F.array("x1", "y1", "x2", "y2")), "pro").select("id", "x1", "y1", "x2", "y2")


@query("scan.bench.v2", "SELECT id, x1, x1 + (x2 - x1) AS x2 FROM boxes")
def _(t: Tables):
    return R.bench_xywh(_ground(t).withColumn("bbox", F.array(c("x1"), c("y1"), c("x2") - c("x1"), c("y2") - c("y1"))), "v2").select("id", "x1", "x2")


@query("scan.bench.mm", "SELECT id, (x1 / w) * w AS x1, (y2 / h) * h AS y2 FROM boxes")
def _(t: Tables):
    df = _ground(t).withColumn("bbox", F.array(c("x1") / c("w"), c("y1") / c("h"), c("x2") / c("w"), c("y2") / c("h"))).withColumn("image_size", F.array("w", "h"))
    return R.bench_normalized(df, "mm").select("id", "x1", "y2")


@query("scan.bench.uiv", "SELECT id, 'uiv' AS benchmark, variant AS instruction FROM boxes")
def _(t: Tables):
    return R.load_bench(_ground(t).withColumn("bbox", F.array("x1", "y1", "x2", "y2")), "uiv").select("id", "benchmark", "instruction")


@query("scan.bench.osw", "SELECT id, CASE WHEN id % 2 = 0 THEN x1 + (x2 - x1) END AS x2, CASE WHEN id % 2 = 1 THEN 2 END AS points, CASE WHEN id % 2 = 1 THEN y2 END AS last FROM boxes")
def _(t: Tables):
    box = F.when(c("id") % 2 == 0, F.array(c("x1"), c("y1"), c("x2") - c("x1"), c("y2") - c("y1"))).otherwise(F.array("x1", "y1", "x2", "y2"))
    df = _ground(t).withColumn("box", box).withColumn("box_type", F.when(c("id") % 2 == 0, "bbox").otherwise("polygon"))
    out = R.bench_polygon(df.drop("x1", "y1", "x2", "y2"), "osw")
    return out.select("id", "x2", F.when(c("polygon").isNotNull(), F.size("polygon")).alias("points"), F.element_at("polygon", -1).y.alias("last"))


@query("scan.bench.dispatch", "SELECT id, 'pro' AS benchmark FROM boxes ORDER BY id LIMIT 40")
def _(t: Tables):
    return R.load_bench(_ground(t).withColumn("bbox", F.array("x1", "y1", "x2", "y2")), "pro", 40).select("id", "benchmark")


@query("udf.loader_registry", "SELECT unnest(['mm', 'osw', 'pro', 'uiv', 'v2']) AS name")
def _(t: Tables):
    return t.spark.createDataFrame([(n,) for n in sorted(R.LOADERS)], "name string")


@query("scan.tar", "SELECT 'f' || id || '.txt' AS name, length(variant) AS size FROM records")
def _(t: Tables):
    """Archives of some three hundred names, written by the tasks: the line end of a text file falls behind an archive's end."""

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w") as tar:
            for i, v in zip(p["id"], p["variant"]):
                info = tarfile.TarInfo(f"f{i}.txt")
                info.size = len(v)
                tar.addfile(info, io.BytesIO(v.encode()))
        return pd.DataFrame({"part": [p["part"].iloc[0]], "g": [p["g"].iloc[0]], "value": [buf.getvalue().decode()]})

    rows = t.records.select("id", "variant", F.floor(c("id") / 1000).alias("part"), (c("id") % 3).alias("g"))
    path = f"{shared_folder(t.spark)}/tars"
    rows.groupBy("part", "g").applyInPandas(pack, "part long, g long, value string").write.partitionBy("part", "g").text(path)
    return R.tar_members(t.spark, path).select("name", "size")


@query("scan.traces", "SELECT episode, count(*) AS n, CASE WHEN count(*) < 60 THEN 'short' WHEN count(DISTINCT variant) < 5 THEN 'variants' END AS reason FROM records GROUP BY 1")
def _(t: Tables):
    """A trace's lines lie together, many traces to a file; a trace larger than a task's share goes on in other files."""
    path = f"{shared_folder(t.spark)}/traces"
    t.records.select("episode", "id", "variant").hint("rebalance", "episode").write.json(path)
    rows = R.jsonl(t.spark, path, "episode long, id long, variant string")
    g = rows.groupBy("episode").agg(F.count("*").alias("n"), F.countDistinct("variant").alias("v"))
    return g.select("episode", "n", V.first_reason([("short", c("n") < 60), ("variants", c("v") < 5)]).alias("reason"))


# --- sinks ---------------------------------------------------------------------------


@query("sink.jsonl", _ALL)
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/out"
    W.jsonl(_rows(t), path)
    return R.jsonl(t.spark, path, ROW)


@query("sink.jsonl.string", """SELECT id // 1000 AS part, string_agg('{"id":' || id || ',"variant":"' || variant || '","k":' || k || ',"note":null}', chr(10) ORDER BY id) AS text FROM records GROUP BY 1""")
def _(t: Tables):
    """One text of a thousand ids each, so a text is bounded."""
    return W.jsonl_text(_rows(t), F.floor(c("id") / 1000).alias("part"), "id")


@query("sink.jsonl.exclusive", f"SELECT count(*) AS n, true AS refused FROM ({_ALL})")
def _(t: Tables):
    path, rows = f"{shared_folder(t.spark)}/out", _rows(t)
    gates = V.gate(rows, [("leak", F.lower("variant").contains("oracle"))])
    W.checked(rows, path, gates)
    try:
        W.checked(rows, path, gates)
        refused = False
    except Exception as e:
        refused = "ALREADY_EXISTS" in str(e)
    return R.jsonl(t.spark, path, ROW).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("sink.jsonl.atomic", _ALL)
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/out"
    for _i in range(2):
        W.jsonl(_rows(t), path, mode="overwrite")
    return R.jsonl(t.spark, path, ROW)


_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("tools", T.ArrayType(T.StringType()))])


@query("sink.parquet.batched", "SELECT id, CAST(k AS INT) AS k, 0 AS tools FROM records")
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/out"
    W.parquet(_rows(t).withColumn("tools", F.array().cast("array<string>")), path, _SCHEMA)
    return t.spark.read.parquet(path).select("id", "k", F.size("tools").alias("tools"))


@query("sink.parquet.pandas", "SELECT true AS refused, count(*) AS n FROM records")
def _(t: Tables):
    path = shared_folder(t.spark)
    try:
        W.parquet(_rows(t).where("false"), f"{path}/empty")
        refused = False
    except ValueError:
        refused = True
    n = W.parquet(_rows(t), f"{path}/full")
    return t.spark.createDataFrame([(refused, n)], "refused boolean, n long")


@query("sink.parquet.arrow", _ALL)
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/out"
    _rows(t).write.parquet(path)
    return t.spark.read.schema(ROW).parquet(path)


@query("sink.parquet.partition", "SELECT variant, count(*) AS n FROM records GROUP BY 1")
def _(t: Tables):
    expected = {r.variant: r.n for r in t.records.groupBy("variant").agg(F.count("*").alias("n")).collect()}
    return W.partitioned(t.records.select("id", "variant"), f"{shared_folder(t.spark)}/out", "variant", expected)


@query("sink.parquet.rewrite", "SELECT id AS row_index, '/data/' || k || '.png' AS image FROM records")
def _(t: Tables):
    rows = t.records.select(c("id").alias("row_index"), F.array(F.concat(c("k").cast("string"), F.lit(".png"))).alias("images"))
    out = W.rewrite(rows, f"{shared_folder(t.spark)}/out", "row_index", "images", "/data")
    return out.select("row_index", F.get("images", 0).alias("image"))


@query("sink.json.atomic", "SELECT count(*) AS n, max(k) AS top FROM records")
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/summary.json"
    r = t.records.agg(F.count("*").alias("n"), F.max("k").alias("top")).first()
    for _i in range(2):
        W.json_file(t.spark, {"top": r.top, "n": r.n}, path)
    return R.json_document(t.spark, path, "n long, top long")


def _facts(tables):
    return {"rows": tables["rows"].count()}


@query("sink.release.atomic", "SELECT count(*) AS \"rows\" FROM records")
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/release"
    W.release(t.spark, path, {"rows": _rows(t)}, _facts)
    return R.json_document(t.spark, f"{path}/summary.json", "rows long")


@query("sink.release.rollback", "SELECT true AS refused, false AS there")
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/release"
    try:
        W.release(t.spark, path, {"rows": _rows(t)}, _facts, [lambda w: V.gate(w["rows"], [("odd", c("id") >= 0)])])
        refused = False
    except ValueError:
        refused = True
    fs, p, _path = W._fs(t.spark, path)
    return t.spark.createDataFrame([(refused, bool(fs.exists(p)))], "refused boolean, there boolean")


@query("sink.cache.step", "SELECT id, CASE WHEN k % 2 = 0 THEN 'cached' ELSE variant END AS v FROM records")
def _(t: Tables):
    rows = _rows(t)
    cache = rows.where("k % 2 = 0").select("id", F.lit("cached").alias("v"))
    return W.cached(rows, cache, "id", "v", lambda miss: miss.withColumn("v", c("variant")))


@query("scan.sql", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    t.events.createOrReplaceTempView("millrace_events")
    return t.spark.sql("SELECT event_type, count(*) AS n FROM millrace_events GROUP BY 1")


@query("hash.file_sha256", "SELECT split, id // 10000 AS part, sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id) || chr(10)) AS sha FROM records GROUP BY 1, 2")
def _(t: Tables):
    """Files of a split's lines among ten thousand ids, written by the tasks and hashed as wholes."""
    lines = F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))
    texts = t.records.groupBy("split", F.floor(c("id") / 10000).alias("part")).agg(F.array_join(lines, "\n").alias("text"))
    path = f"{shared_folder(t.spark)}/files"
    texts.write.partitionBy("split", "part").text(path)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = lambda k: F.regexp_extract("path", f"/{k}=([^/]+)/", 1)
    return files.select(name("split").alias("split"), name("part").cast("long").alias("part"), F.sha2("content", 256).alias("sha"))
