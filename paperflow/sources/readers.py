"""Readers and writers: explicit schemas, no inference; dimensions are small tables that the caller supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import KeyedTable

PARTY = "kurum_kodu string, kurum_adi string, kurum_tipi string, birim_kodu string, birim_adi string, detsis_no string, imza_unvani string"
UNIT = "birim_kodu string, birim_adi string, ust_birim_kodu string, hiyerarsi_seviyesi string, gorev_alani string, sdp_kodlari string, vatandas_yogunlugu string, imza_unvani string, detsis_no string"
CATALOG = "kod string, ana_grup string, seviye string, ust_kod string, ad string, saklama_suresi string, kapsam string, kurum_tipi string, vatandas_konusu string, ornek_konular string"


def label_schema() -> T.StructType:
    party = ", ".join(x.replace(" ", ": ") for x in PARTY.split(", "))
    return T.StructType.fromDDL(
        f"belge_no string, tohum int, alici struct<{party}>, "
        "gonderen struct<tip: string, kurum_adi: string, ad: string, adres: string, detsis_no: string, detsis_kaynagi: string>, "
        "belge_turu string, aile string, yazan_tipi string, hiyerarsi_yonu string, muhatap_makam string, muhatap_parantez string, dagitim string, "
        "beklenen_kapanis string, sdp struct<kod: string, ad: string, saklama_suresi: string>, konu string, sayi string, tarih string, "
        "ilgi struct<tarih: string, sayi: string>, ek struct<adet: int, aciklama: string>, somut_bilgiler map<string, string>, "
        "paragraf_cumle_sayilari array<int>, pdf_bicimi string, kusur string, "
        "kusur_ayrinti struct<alan: string, yontem: string, dogru_deger: string, enjekte_edilen: string, beklenen_kapanis: string>, "
        "yasakli_adlar array<string>, anahtar_terimler array<string>, _corrupt_record string"
    )


def file_number(path: Column) -> Column:
    """The last `_` part of a file's stem."""
    return F.regexp_extract(path, r"([^_/]+)\.[^./]+$", 1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One label per JSON file; unreadable files have _corrupt_record set and other columns null."""
    return spark.read.schema(label_schema()).option("multiLine", True).json(path).withColumn("doc_no", file_number(F.col("_metadata.file_path")))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """doc_no, text: one row per whole file."""
    return spark.read.text(path, wholetext=True).select(file_number(F.col("_metadata.file_path")).alias("doc_no"), F.col("value").alias("text"))


def listed(c: Column, separator: str) -> Column:
    """The trimmed entries of a separated list, without blanks; an empty array for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def _csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Header CSV files as strings, columns by the header's names (a byte-order mark before the first is dropped), in order."""
    wanted = [x.split()[0] for x in schema.split(", ")]
    out = None
    for i, path in enumerate(paths):
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
        part = raw.select(*[F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in wanted], F.lit(i).alias("file_ord"), F.monotonically_increasing_id().alias("row_ord"))
        out = part if out is None else out.unionByName(part)
    return out


def read_units(spark: SparkSession, paths: list[str]) -> DataFrame:
    """units(code, name, parent_code, level, duties, sdp_codes, title, detsis_no, routable), files in order; a repeated code
    keeps its first row."""
    rows = _csv(spark, paths, UNIT)
    level = F.coalesce(F.col("hiyerarsi_seviyesi").try_cast("int"), F.lit(0))
    first = F.row_number().over(Window.partitionBy("birim_kodu").orderBy("file_ord", "row_ord"))
    out = rows.where(F.trim("birim_kodu") != "").withColumn("n", first).where("n = 1")
    return out.select(
        F.col("birim_kodu").alias("code"), F.col("birim_adi").alias("name"), F.nullif(F.trim("ust_birim_kodu"), F.lit("")).alias("parent_code"), level.alias("level"), F.col("gorev_alani").alias("duties"),
        listed(F.col("sdp_kodlari"), ";").alias("sdp_codes"), F.col("imza_unvani").alias("title"), F.nullif(F.trim("detsis_no"), F.lit("")).alias("detsis_no"), (level != 1).alias("routable"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """catalog(code, name, retention, subjects, ord): rows without a code are dropped, a later row of a code wins."""
    rows = _csv(spark, [path], CATALOG).where(F.trim("kod") != "")
    rows = rows.select(F.trim("kod").alias("code"), F.struct(F.col("row_ord"), F.col("ad").alias("name"), F.col("saklama_suresi").alias("retention"), listed(F.col("ornek_konular"), r"\|").alias("subjects")).alias("r"))
    last = rows.groupBy("code").agg(F.max_by("r", "r.row_ord").alias("r"), F.min("r.row_ord").alias("ord"))
    return last.select("code", "r.name", "r.retention", "r.subjects", "ord")


def split_batches(answers: DataFrame, id_col: str = "batch", text_col: str = "text") -> DataFrame:
    """batch, ord, doc_no, body: one answer text cut at its separator lines; what stands before the first has ord 0 and no number."""
    line = r"(?mi)^#{2,4}[ \t]*BELGE[ \t]*(\d{1,3})[ \t]*$"
    marked = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), line, "\u0001$1\u0002")
    pieces = answers.select(F.col(id_col).alias("batch"), F.posexplode(F.split(marked, "\u0001")).alias("ord", "piece"))
    body = F.when(F.col("ord") == 0, F.col("piece")).otherwise(F.substring_index("piece", "\u0002", -1))
    number = F.when(F.col("ord") > 0, F.lpad(F.substring_index("piece", "\u0002", 1), 3, "0"))
    return pieces.select("batch", "ord", number.alias("doc_no"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("body")).where("ord > 0 or body <> ''")


def write_documents(docs: DataFrame, path: str, key: tuple[str, ...] = ("kurum", "doc_id")) -> dict:
    """Saves documents: those that the table at path has are replaced, others added, the rest stays. Returns the commit."""
    return KeyedTable(docs.sparkSession, path, list(key)).save(docs)


def saved(spark: SparkSession, path: str, key: tuple[str, ...] = ("kurum", "doc_id")) -> DataFrame:
    """All documents or results that saves have left at path."""
    return KeyedTable(spark, path, list(key)).read()


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Readable rows of JSON documents, and the texts of those that aren't."""
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
    return raw.where("_corrupt_record is null").drop("_corrupt_record"), raw.where("_corrupt_record is not null").select("_corrupt_record")


def write_result(rows: DataFrame, path: str, key: tuple[str, ...]) -> dict:
    """Saves findings, routes, decisions or register rows by their key, as write_documents() does."""
    return KeyedTable(rows.sparkSession, path, list(key)).save(rows)
