"""File inventories and readers of manifests, mappings, evidence, query sheets and ground truth."""

from __future__ import annotations

import csv
import json
import posixpath
import zipfile
from collections.abc import Iterator
from io import BytesIO, StringIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parent, stem, suffix
from ..schemas import EVIDENCE, GROUND_TRUTH, MAPPING
from .xls import xls_rows

IMAGES = (".jpg", ".jpeg", ".png", ".webp")
VIDEOS = (".mp4", ".mkv", ".mov", ".webm")
#: Column names by role, in order of preference (fixed values).
ROLES = {
    "video_id": ("video_id", "video", "vid", "videoid"),
    "frame_id": ("frame_id", "frame_idx", "frame", "keyframe_id", "original_frame_id"),
    "text": ("text", "transcript", "asr", "ocr", "caption", "content", "value", "description"),
}
QUERY_IDS = ("Query Name", "query_id", "id", "name")


def contents(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length, content) of the files below root with one of the suffixes, in any case.  A missing root has no
    files."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long, content binary")
    return found.where(suffix(F.col("path")).isin(*suffixes))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def inventory(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length) of such files; contents aren't read."""
    return contents(spark, root, suffixes).select("path", "length")


def image_inventory(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    rows = inventory(spark, root, suffixes)
    return rows.select(parent(F.col("path")).alias("video_id"), stem(F.col("path")).alias("keyframe_name"), F.col("path").alias("keyframe_path"), suffix(F.col("path")).alias("suffix"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A manifest: Parquet or, by its suffix, CSV with a header."""
    return spark.read.parquet(path) if path.lower().endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_mapping(spark: SparkSession, root: str) -> DataFrame:
    """Mapping CSVs with exact headers, and video_id from the file's name."""
    rows = spark.read.schema(MAPPING).option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True).csv(root)
    return rows.withColumn("video_id", stem(F.col("_metadata.file_path")))


def read_mapping_tolerant(spark: SparkSession, root: str) -> DataFrame:
    """Mapping CSVs whose headers may differ in case, blanks and order: (video_id, path, pos, n, pts_time, fps, frame_idx,
    error); pos counts a file's rows.  A file without one of the columns is a row with an error; cells that aren't
    numbers are null."""
    wanted = [f.name for f in MAPPING]

    def parse(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                video = posixpath.splitext(posixpath.basename(path))[0]
                try:
                    cells = list(csv.reader(StringIO(bytes(content).decode("utf-8-sig"))))
                    at = {str(c).strip().lower(): i for i, c in enumerate(cells[0] if cells else [])}
                    if missing := [w for w in wanted if w not in at]:
                        raise ValueError(f"mapping columns missing: {', '.join(missing)}")
                    body = [r for r in cells[1:] if r]
                    made = pd.DataFrame({w: pd.to_numeric(pd.Series([r[at[w]] if at[w] < len(r) else None for r in body], dtype=object), errors="coerce") for w in wanted}, columns=wanted).astype(float)
                    yield made.assign(video_id=video, path=path, pos=range(len(made)), error=None)
                except (ValueError, csv.Error) as e:
                    yield pd.DataFrame([{"video_id": video, "path": path, "error": str(e)}]).reindex(columns=["video_id", "path", "pos", *wanted, "error"])

    found = contents(spark, root, (".csv",))
    return found.mapInPandas(parse, "video_id string, path string, pos long, n double, pts_time double, fps double, frame_idx double, error string")


def pick_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first exact match in order of preference (of columns equal but for case and blanks the last), else the
    first column that contains a name."""
    low = {c.strip().lower(): c for c in columns}
    for n in names:
        if n.lower() in low:
            return low[n.lower()]
    return next((c for c in columns if any(n.lower() in c.strip().lower() for n in names)), None)


def read_json_evidence(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """Evidence rows of JSON lines, or of one .json list or object; unreadable rows are dropped.  Of a
    field's aliases the first that is present counts, even if null."""
    raw = spark.read.option("wholetext", path.lower().endswith(".json")).text(path)
    node = raw.select(F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL")
    each = node.select(F.expr("explode(CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN cast(v AS array<variant>) ELSE array(v) END)").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT%'")
    each = each.withColumn("m", F.expr("cast(v AS map<string, variant>)"))

    def first(*names: str):
        out = None
        for n in reversed(names):
            here = F.expr(f"cast(m['{n}'] AS string)")
            out = here if out is None else F.when(F.map_contains_key("m", F.lit(n)), here).otherwise(out)
        return out

    text = F.coalesce(first("text", "transcript", "caption", "ocr"), F.when(F.exists(F.map_keys("m"), lambda k: k.isin("text", "transcript", "caption", "ocr")), "None").otherwise(""))
    rows = each.select(F.lit(modality).alias("modality"), first("video_id", "video").alias("video_id"), first("frame_id", "frame_idx").alias("frame"), text.alias("text"))
    return rows.select("modality", "video_id", F.expr("try_cast(frame AS BIGINT)").alias("frame_id"), "text").to(EVIDENCE)


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet, as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iterfind(".//m:row", ns):
            cells: list[str] = []
            for c in row.findall("m:c", ns):
                at = 0
                for ch in c.get("r", "").rstrip("0123456789"):
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
                else:
                    v = c.find("m:v", ns)
                    cells.append(shared[int(v.text)] if c.get("t") == "s" else (v.text or "") if v is not None else "")
            out.append(cells)
    return out


def read_queries(spark: SparkSession, path: str, query_column: str = "Description", translated: str | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """(query_id, query_text[, translated]) of a csv, json, xlsx or xls sheet: blank queries go, of equal ids the first stays."""
    kind = posixpath.splitext(path.lower())[1]
    if kind == ".csv":
        rows = [r.asDict() for r in spark.read.option("header", True).option("multiLine", True).csv(path).toLocalIterator()]
    elif kind in (".json", ".xlsx", ".xls"):
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        if kind == ".json":
            made = json.loads(data.decode("utf-8-sig"))
            rows = made["queries"] if isinstance(made, dict) else made
        else:
            header, *body = (xlsx_rows if kind == ".xlsx" else xls_rows)(data) or [[]]
            rows = [dict(zip(header, r + [""] * (len(header) - len(r)), strict=False)) for r in body]
    else:
        raise ValueError(f"unsupported query file: {path}")
    columns = list(dict.fromkeys(c for r in rows for c in r))
    key = next((c for c in QUERY_IDS if c in columns), None)
    if key is None or query_column not in columns:
        raise ValueError("the query sheet lacks an id or query column")
    seen: dict[str, tuple] = {}
    for r in rows:
        text = str(r.get(query_column) or "").strip()
        name = str(r.get(key) or "")
        if text and name not in seen and (not prefixes or name.startswith(tuple(prefixes))):
            seen[name] = (name, text, str(r.get(translated) or "") if translated in columns else "")
    return spark.createDataFrame(list(seen.values()), "query_id string, query_text string, translated string")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth by query: a dict of queries, or a list with query ids."""
    made = json.loads("\n".join(r[0] for r in spark.read.text(path).toLocalIterator()))
    rows = [{"query_id": k} | v for k, v in made.items()] if isinstance(made, dict) else made
    fill = [(str(r["query_id"]), r.get("video_ids") or [], r.get("frames") or {}, r.get("intervals") or {}) for r in rows]
    return spark.createDataFrame(fill, GROUND_TRUTH)


def ground_truth_intervals(truth: DataFrame) -> DataFrame:
    """(query_id, video_id, event_ord, s, e)."""
    each = truth.select("query_id", F.explode("intervals").alias("video_id", "list"))
    return each.select("query_id", "video_id", F.posexplode("list").alias("event_ord", "i")).select("query_id", "video_id", "event_ord", F.col("i")[0].alias("s"), F.col("i")[1].alias("e"))


def ground_truth_template(queries: DataFrame, task_type) -> DataFrame:
    empty = {"video_ids": "array<string>", "frames": "map<string,array<bigint>>", "intervals": "map<string,array<array<bigint>>>", "events": "array<string>"}
    columns = [F.lit(None).cast(t).alias(n) for n, t in empty.items()]
    return queries.select("query_id", "query_text", task_type(F.col("query_id")).alias("task_type"), *columns, F.lit("").alias("notes"))
