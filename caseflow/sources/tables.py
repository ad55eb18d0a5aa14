"""Scans and sinks: declared schemas, catalogues in JSON, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import text as X
from caseflow.operators.match import bounded
from caseflow.operators.quality import fill_defaults

#: Column names and types of the work-tracking tables.
SCHEMAS = {
    "cases": "case_id long, owner_id long, numero_processo string, estado string, comarca string, cliente string, parte_interessada string, parte_adversa_nome string, data_distribuicao string, data_admissao string, data_demissao string, salario string, pis string, ctps string, valor_causa string, pedidos_json string, external_status string, updated_at timestamp, created_at timestamp",
    "batches": "batch_id long, owner_id long, status string, total_count int, processed_count int, queue_position int, queued_at timestamp, started_at timestamp, finished_at timestamp",
    "batch_items": "item_id long, batch_id long, case_id long, source_filename string, upload_path string, file_size long, status string, attempt_count int, last_error string, updated_at timestamp",
    "status_events": "case_id long, step string, status string, message string, data string, ts timestamp",
    "annex_locations": "case_id long, doc_type string, page_number int, total_pages int, source string, confidence double, arrival long",
    "page_text": "doc_id long, page_no int, text string, file_bytes long",
    "activity_log": "line string, ts timestamp",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table by its declared schema; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_page_files(spark: SparkSession, path: str, marker: str = r"\[P[ÁA]GINA (\d+)\]") -> DataFrame:
    """(path, page_no, text) of text files in which markers begin pages."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    numbers, bodies = F.regexp_extract_all("value", F.lit(marker), F.lit(1)), F.slice(F.split("value", marker, -1), 2, 1_000_000)
    page = F.explode(F.arrays_zip(numbers.alias("no"), bodies.alias("text")))
    return whole.select("path", page.alias("p")).select("path", F.col("p.no").cast("int").alias("page_no"), F.regexp_replace("p.text", r"^\s+|\s+$", "").alias("text"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of files; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def _json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(place, key, value) of a JSON object in a file, in its order; keys that begin with _ are comments."""
    body = spark.read.text(path, wholetext=True)
    return body.select(F.posexplode(F.map_filter(F.from_json("value", f"map<string, {value}>"), lambda k, v: ~k.startswith("_"))).alias("place", "key", "value"))


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """S3: (name, client, cell, ordinal): a party per row, of an object client -> {nome_cliente, partes, celula}; ``ordinal`` follows the file."""
    rows = _json_map(spark, path, "struct<nome_cliente: string, partes: array<string>, celula: string>")
    parts = rows.select(F.coalesce("value.nome_cliente", "key").alias("client"), F.col("value.celula").alias("cell"), "place", F.posexplode("value.partes").alias("k", "name"))
    return parts.select("name", "client", "cell", (F.col("place").cast("long") * (1 << 24) + F.col("k")).alias("ordinal"))


def load_region_map(spark: SparkSession, path: str) -> DataFrame:
    """(code, state, uf, ufs, court, spellings)."""
    rows = _json_map(spark, path, "struct<estado: string, uf: string, ufs: array<string>, trt_nome: string, variantes: array<string>>")
    return rows.select(F.col("key").alias("code"), F.col("value.estado").alias("state"), F.col("value.uf").alias("uf"), F.coalesce("value.ufs", F.array("value.uf")).alias("ufs"), F.col("value.trt_nome").alias("court"), F.col("value.variantes").alias("spellings"))


def load_options(spark: SparkSession, path: str) -> DataFrame:
    """(value, text, normalized) of a JSON array, in its order."""
    body = spark.read.text(path, wholetext=True)
    rows = body.select(F.posexplode(F.from_json("value", "array<struct<value: string, text: string>>")).alias("ordinal", "o"))
    return rows.select("ordinal", "o.value", "o.text", X.fold("o.text", "slug").alias("normalized"))


def save_options(options: DataFrame, path: str) -> None:
    """A JSON array in one file, as ``load_options`` reads it, in the order of ``ordinal`` (if there is one, else of text and value).

    Options are a catalogue of bounded size; more is an error.
    """
    order = [F.col("ordinal")] if "ordinal" in options.columns else []
    row = F.struct("value", "text", X.fold("text", "slug").alias("normalized"))
    rows = bounded(options.select(*order, "value", "text"), "options").agg(F.array_sort(F.collect_list(F.struct(*(o.alias("o") for o in order), "text", "value", row.alias("row")))).alias("rows"))
    rows.select(F.to_json(F.transform("rows", lambda r: r["row"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def parse_json_column(df: DataFrame, column: str, element: str = "string") -> DataFrame:
    """S7"""
    return df.withColumn(column, X.parse_json_array(column, element))


def case_defaults() -> dict[str, list]:
    """What a case row holds where nothing was found: columns in order, then a literal."""
    return {"tipo_processo": ["tipo_processo", F.lit("Eletrônico")], "sistema_eletronico": ["sistema_eletronico", F.lit("PJE")], "instancia": ["instancia", F.lit("Primeira Instância")], "celula": ["celula", "escritorio", "cliente", F.lit("Em Segredo")]}


def write_cases(df: DataFrame, path: str, spec: dict[str, list] | None = None, by: tuple[str, ...] = ()) -> None:
    """Rows with their defaults, as a new snapshot."""
    spec = spec if spec is not None else case_defaults()
    absent = {c for chain in spec.values() for c in chain if isinstance(c, str) and c not in df.columns}
    full = df.withColumns({c: F.lit(None).cast("string") for c in absent})
    out = fill_defaults(full, spec).drop(*(c for c in absent if c not in spec))
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def project_payload(cases: DataFrame, fields: dict[str, str], upper: tuple[str, ...] = ()) -> DataFrame:
    """Fields renamed and trimmed, blanks null."""
    pick = lambda source: X.unblank(F.trim(F.col(source).cast("string")))
    return cases.select(*((F.upper(pick(s)) if name in upper else pick(s)).alias(name) for name, s in fields.items()))


def write_report(results: DataFrame, path: str, file: str = "file") -> None:
    """{file, data} rows as JSON."""
    data = F.struct(*(c for c in results.columns if c != file))
    results.select(F.col(file).alias("file"), data.alias("data")).write.mode("overwrite").json(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMAS[name]))
