"""Manifests, artifacts and extracts as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.commits import exists

MANIFEST = T.StructType(
    [
        T.StructField("case_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("reader", T.StringType()),
        T.StructField("radiologist_id", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("body_part", T.StringType()),
        T.StructField("report_pdf", T.StringType()), T.StructField("report_text", T.StringType()), T.StructField("report_text_path", T.StringType()),
        T.StructField("image_paths", T.ArrayType(T.StringType())), T.StructField("volume_path", T.StringType()),
        T.StructField("derived_assets", T.MapType(T.StringType(), T.StringType())), T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)


def _first(*names: str, default: str | None = None):
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(default)).alias(names[0])


def _aliased(rows: DataFrame) -> DataFrame:
    return rows.select(
        _first("case_id", "id"), _first("reader", "radiologist_id", default="unknown"), _first("modality", default="unknown"), _first("body_part", default="unknown"),
        "report_pdf", _first("report_text", "report_text_path"), F.coalesce("image_paths", F.array()).alias("image_paths"), "volume_path",
        F.coalesce("derived_assets", F.create_map().cast("map<string,string>")).alias("derived_assets"), F.coalesce("warnings", F.array()).alias("warnings"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL manifest, which fails on its first bad line. Blank lines are passed over; older names are read too."""
    return _aliased(spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path))


def tolerant_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of a JSONL manifest, and the bad lines as rows with an error, their file and a number that orders them in it."""
    with_bad = T.StructType([*MANIFEST.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    rows = lines.where(F.trim("value") != "").select(parsed, "__file", "__block", "__at").select("r.*", "__file", "__block", "__at")
    bad = F.col("_corrupt_record").isNotNull()
    wrong = rows.where(bad).select(
        F.lit("invalid_manifest_jsonl").alias("error"), F.col("_corrupt_record").alias("line"), F.col("__file").alias("file"), F.struct(F.col("__block").alias("block"), F.col("__at").alias("at")).alias("place")
    )
    return _aliased(rows.where(~bad).drop("__file", "__block", "__at")), wrong


def documents(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """One JSON object per file, with the path it came from; a file that holds no object fails the read."""
    texts = spark.read.text(pattern, wholetext=True).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("path"))
    holds = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    checked = texts.withColumn("value", F.when(holds, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON object in "), "path"))))
    return checked.select(F.from_json("value", schema).alias("d"), "path").select("d.*", "path")


def case_documents(spark: SparkSession, primary: str, fallback: str, schema: T.StructType) -> DataFrame:
    """The documents ``<case>.json`` of two folders, by name; of a case that both have the first folder's. A missing folder is empty."""
    found = []
    for rank, folder in enumerate((primary, fallback)):
        if exists(spark, folder):
            found.append(documents(spark, f"{folder}/*.json", schema).withColumn("__rank", F.lit(rank)))
    if not found:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("path", T.StringType()), T.StructField("case_id", T.StringType())]))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    named = rows.withColumn("__case", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    fields = F.struct(*[c for c in named.columns if not c.startswith("__") and c != "case_id"])
    first = named.groupBy("__case").agg(F.min_by(fields, F.struct("__rank", "path")).alias("d"))
    return first.select("d.*", F.col("__case").alias("case_id"))


def followed(rows: DataFrame, column: str, cases: DataFrame, roots: list[str]) -> DataFrame:
    """Rows with the document that a path column names, joined by path: as it stands, else below each root in order.

    ``cases`` are read once by ``documents`` (path and fields); there is no file access by row. A path that names none gives nulls.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), "/+", "/")
    tries = [F.col(column), *(F.concat(F.lit(r.rstrip("/") + "/"), F.col(column)) for r in roots)]
    marked = rows.withColumn("__row", F.monotonically_increasing_id())
    named = marked.select("__row", F.posexplode(F.array(*map(bare, tries))).alias("__try", "__path"))
    body = cases.select(bare(F.col("path")).alias("__path"), F.struct(*[c for c in cases.columns if c != "path"]).alias("document"))
    hit = named.join(body, "__path").groupBy("__row").agg(F.min_by("document", "__try").alias("document"))
    return marked.join(hit, "__row", "left").drop("__row")


def extract(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """A CSV extract with a heading; ``limit`` is the display's row limit. A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.limit(limit) if limit is not None else rows


def any_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a manifest and its errors: JSON lines by the name ``.jsonl``, else a JSON array or an object with ``cases``.

    A file that is neither gives one error row; so does an entry that is no object.
    """
    if path.lower().endswith(".jsonl"):
        return tolerant_manifest(spark, path)
    texts = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.cases"))
    entries = F.when(F.trim(listed).startswith("["), F.from_json(listed, "array<string>"))
    valid = F.try_parse_json("value").isNotNull()
    items = texts.select("value", valid.alias("valid"), F.when(valid, entries).alias("entries"))
    error = F.when(~F.col("valid"), "invalid_json").otherwise("root_must_be_list_or_cases_array")
    bad_files = items.where(F.col("entries").isNull()).select(error.alias("error"), F.col("value").alias("line"))
    each = items.select(F.explode("entries").alias("line"))
    is_object = F.coalesce(F.trim("line").startswith("{"), F.lit(False))
    rows = each.where(is_object).select(F.from_json("line", MANIFEST).alias("r")).select("r.*")
    return _aliased(rows), bad_files.unionByName(each.where(~is_object).select(F.lit("entry_is_no_object").alias("error"), "line"))


def _first_sheet(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as text, by the public Office Open XML layout."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{space}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        root = ElementTree.fromstring(book.read(sheets[0]))
    out = []
    for row in root.iter(f"{space}row"):
        cells = {}
        for place, cell in enumerate(row.iter(f"{space}c")):
            letters = re.match(r"[A-Z]*", cell.get("r", "")).group()
            at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else place
            value = cell.find(f"{space}v")
            text = "".join(t.text or "" for t in cell.iter(f"{space}t")) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
            cells[at] = shared[int(text)] if cell.get("t") == "s" and text else text
        out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


def xlsx_dimension(spark: SparkSession, path: str, key: str = "ID", value: str = "Reader") -> DataFrame:
    """(key, value) of a small workbook's first sheet; the last row wins. Empty without the file or either column."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], "key string, value string")
    try:
        files = spark.read.format("binaryFile").load(path).select("content").collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty
    rows = _first_sheet(bytes(files[0].content)) if files else []
    if not rows or key not in rows[0] or value not in rows[0]:
        return empty
    k, v = rows[0].index(key), rows[0].index(value)
    found = {r[k]: r[v] if v < len(r) else "" for r in rows[1:] if k < len(r) and r[k]}
    return spark.createDataFrame(list(found.items()), "key string, value string") if found else empty


def yaml_dimension(spark: SparkSession, pattern: str) -> DataFrame:
    """(id, body as JSON, path) of small YAML documents; an id that two of them have, or that one lacks, is an error."""
    import json

    import yaml

    files = spark.read.format("binaryFile").load(pattern).select("path", "content").orderBy("path").collect()
    seen: dict[str, tuple[str, str, str]] = {}
    for f in files:
        body = yaml.safe_load(bytes(f.content).decode()) or {}
        if not isinstance(body, dict) or not body.get("id"):
            raise ValueError(f"no id in {f.path}")
        if str(body["id"]) in seen:
            raise ValueError(f"id {body['id']!r} in {f.path} and {seen[str(body['id'])][2]}")
        seen[str(body["id"])] = (str(body["id"]), json.dumps(body, ensure_ascii=False, default=str, sort_keys=True), f.path)
    return spark.createDataFrame(list(seen.values()), "id string, body string, path string")


def discovered_cases(spark: SparkSession, root: str, readers: DataFrame | None = None) -> DataFrame:
    """Cases of a tree root/modality/case/...: images are files whose name starts with Y, the report is report.pdf.

    Only paths are read. Folders without any file cannot be seen; hidden modality folders are left out. ``readers`` is (key, value).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = root.split(":", 1)[-1].strip("/")
    rest = F.split(F.substring_index("path", f"/{base}/", -1), "/")
    rows = files.select("path", rest.alias("p")).where((F.size("p") >= 3) & ~F.get("p", F.lit(0)).startswith("."))
    name = F.element_at("p", -1)
    pdf = (name == "report.pdf") & (F.size("p") == 3)
    found = rows.groupBy(F.get("p", F.lit(0)).alias("modality_dir"), F.get("p", F.lit(1)).alias("case_id")).agg(
        F.array_sort(F.collect_list(F.when(name.startswith("Y"), F.col("path")))).alias("image_paths"), F.max(F.when(pdf, F.col("path"))).alias("report_pdf")
    )
    warnings = F.array_compact(F.array(F.when(F.size("image_paths") == 0, "missing_image_files"), F.when(F.col("report_pdf").isNull(), "missing_report_pdf")))
    found = found.withColumn("warnings", warnings).withColumn("report_pdf", F.coalesce("report_pdf", F.lit("")))
    if readers is None:
        return found.withColumn("reader", F.lit("unknown"))
    return found.join(readers.select(F.col("key").alias("case_id"), F.col("value").alias("reader")), "case_id", "left").fillna("unknown", ["reader"])


def runs(spark: SparkSession, path: str, limit: int = 50, status: str | None = None) -> DataFrame:
    """The latest runs of a registry table, newest first, then by id; ``limit`` is the display's, held to 1 to 1000."""
    limit = min(1000, max(1, limit))
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.orderBy(F.desc("created_at"), "run_id").limit(limit)


def issues(spark: SparkSession, pattern: str, prefix: str) -> DataFrame:
    """Issues ``<prefix><number>. title | details`` of Markdown files, from their mark to the next one of the prefix or the end.

    id, title (the part before the first bar), location (the first part that names a place or a source line) and the first 500
    characters, as the panel shows them.
    """
    mark = rf"(?:###\s+|[-*]\s+)?(?:\*\*)?{prefix}"
    texts = spark.read.text(pattern, wholetext=True)
    each = texts.select(F.posexplode(F.regexp_extract_all("value", F.lit(rf"(?ms)(^{mark}\d+\.\s*.*?(?=\n{mark}\d+\.\s*|\z))"), F.lit(1))))
    body = F.trim(F.regexp_replace(F.regexp_replace("col", rf"(?s)\A{mark}\d+\.\s*", ""), r"\*\*", ""))
    body = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    rows = each.select(F.concat(F.lit(prefix), F.regexp_extract("col", rf"{mark}(\d+)\.", 1)).alias("id"), body.alias("full"))
    parts = F.transform(F.split("full", r"\|"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    place = F.get(F.filter(parts, lambda p: p.contains("位置:") | p.contains(".py:") | p.contains(".yaml:")), F.lit(0))
    return rows.select("id", F.get(parts, F.lit(0)).alias("title"), F.trim(F.coalesce(F.replace(place, F.lit("位置:"), F.lit("")), F.lit(""))).alias("location"), F.substring("full", 1, 500).alias("full_text"))
