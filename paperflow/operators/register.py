"""In/out registers with gap-free numbers, and the state of documents under user actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_parts
from ..sources.keyed import KeyedTable
from ..sources.scratch import written

KEY = ["direction", "institution"]
APPROVERS = ["birim_amiri", "yonetici", "memur"]
NEEDS_REASON = ["reddet", "birim_degistir", "karari_geri_al"]
OPEN = ["insan_onayi_bekliyor", "eksik_bilgi_bekliyor", "isleniyor"]
ACTIONS = ["onayla", "reddet", "birim_degistir", "taslak_kaydet", "eksik_bilgi_iste", "eksik_bilgi_cevabi", "karari_geri_al", "deftere_kaydet"]
CORRECTS = ["reddet", "birim_degistir", "taslak_kaydet"]
CLOSED = ["onaylandi", "reddedildi", "otomatik_onaylandi"]


def assign_numbers(new: DataFrame, register: DataFrame | None = None, slots: int = 64) -> DataFrame:
    """direction, institution, doc_id, seq: documents that the register has keep their number, new ones follow its highest
    without gaps in the order of (ts, doc_id); numbers are never reset. A document that comes twice counts once.

    A few institutions hold most rows, so no window spans an institution: rows are ranged over (key, ts, doc_id), numbered
    inside each range, and the ranges' counts are summed ahead of it (one row for each key and range). The ranges are written first,
    as numbers and counts must see the same ones."""
    rows = new.groupBy(*KEY, "doc_id").agg(F.min("ts").alias("ts"))
    if register is not None:
        rows = rows.join(register.select(*KEY, "doc_id"), [*KEY, "doc_id"], "left_anti")
    ranged = written(rows.repartitionByRange(slots, *KEY, "ts", "doc_id").withColumn("part", F.spark_partition_id()), "ranged")
    inner = Window.partitionBy("part", *KEY).orderBy("ts", "doc_id")
    numbered = ranged.withColumn("n", F.row_number().over(inner))
    counts = ranged.groupBy("part", *KEY).agg(F.count("*").alias("c"))
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    out = numbered.join(offsets, ["part", *KEY])
    if register is not None:
        last = register.groupBy(*KEY).agg(F.max("seq").alias("last"))
        out = out.join(last, KEY, "left")
        added = out.select(*KEY, "doc_id", (F.col("n") + F.col("before") + F.coalesce("last", F.lit(0))).cast("long").alias("seq"))
        return register.select(*KEY, "doc_id", F.col("seq").cast("long").alias("seq")).unionByName(added)
    return out.select(*KEY, "doc_id", (F.col("n") + F.col("before")).cast("long").alias("seq"))


def register_numbers(at: KeyedTable, new: DataFrame) -> DataFrame:
    """direction, institution, doc_id, seq of the new documents, from a register that several writers number at once. at: a table with the
    key (direction, institution, doc_id).

    Numbers count from the register as one version has it and are saved as the next version or not at all; a writer that comes second
    numbers anew. So numbers stay without gaps and repeats, also when a writer fails before its commit."""

    def numbered(register: DataFrame | None) -> DataFrame:
        rows = assign_numbers(new, register)
        return rows if register is None else rows.join(register.select(*KEY, "doc_id"), [*KEY, "doc_id"], "left_anti")

    at.transact(numbered)
    return at.lookup(new.select(*KEY, "doc_id").distinct())


def official_numbers(rows: DataFrame) -> DataFrame:
    """doc_id, number, problem: E-detsis-sdp-seq, which must parse back; missing or malformed parts give a problem."""
    number = F.concat(F.lit("E-"), F.col("detsis"), F.lit("-"), F.col("sdp"), F.lit("-"), F.col("seq").cast("string"))
    problem = F.when(F.col("detsis").isNull(), "detsis_yok").when(F.col("sdp").isNull(), "sdp_yok").when(F.col("seq").isNull(), "sira_yok").when(number_parts(number).isNull(), "bicim")
    return rows.select("doc_id", F.when(problem.isNull(), number).alias("number"), problem.alias("problem"))


def incoming_stamp(ts: Column, seq: Column) -> Column:
    return F.concat(F.lit("Evrak Tarih ve Sayısı: "), F.date_format(ts, "dd/MM/yyyy"), F.lit("-"), seq.cast("string"))


def register_rows(rows: DataFrame) -> DataFrame:
    """Columns by direction: incoming rows show the sender and the stamp, outgoing the addressee and the official number."""
    incoming = F.col("direction") == "gelen"
    return rows.select(*KEY, "seq", "doc_id", F.when(incoming, F.col("sender")).otherwise(F.col("addressee")).alias("party"), F.when(incoming, incoming_stamp(F.col("ts"), F.col("seq"))).otherwise(F.col("number")).alias("mark"), "subject", F.to_date("ts").alias("day"))


def search(register: DataFrame, direction: str | None = None, institution: str | None = None, text: str | None = None) -> DataFrame:
    """Register rows by direction, institution and a text in subject, number or party, in register order."""
    rows = register
    for c, v in (("direction", direction), ("institution", institution)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if text:
        low = text.lower()
        rows = rows.where(F.coalesce(F.lower("subject").contains(low), F.lit(False)) | F.coalesce(F.lower("number").contains(low), F.lit(False)) | F.coalesce(F.lower("party").contains(low), F.lit(False)))
    return rows.orderBy("institution", "direction", "seq")


def summary(register: DataFrame) -> DataFrame:
    return register.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def with_targets(actions: DataFrame, units: DataFrame | None) -> DataFrame:
    """actions with target: whether new_unit can be routed to. units: code, routable; None: every unit that is named can."""
    if units is None:
        return actions.withColumn("target", F.col("new_unit").isNotNull())
    known = units.where("routable and code is not null").select(F.col("code").alias("_unit")).distinct().withColumn("_known", F.lit(True))
    return actions.join(known, actions["new_unit"] == F.col("_unit"), "left").withColumn("target", F.coalesce("_known", F.lit(False))).drop("_unit", "_known")


def apply_actions(docs: DataFrame, actions: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """doc_id, status, decision, unit, corrections, accepted, rejected (array of action_id and reason) after all actions.

    docs: doc_id, status, unit. actions: doc_id, action_id, ts, role, action, reason, new_unit. Actions of a document fold in
    the order of (ts, action_id): roles without the right, missing reasons and states that bar an action reject it, and a change to a
    unit that doesn't exist or can't be a target (units: code, routable; None: any unit that is named)."""
    rows = with_targets(actions, units).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("ts", "action_id", "role", "action", "reason", "new_unit", "target"))).alias("a"))
    both = docs.select("doc_id", "status", "unit").join(rows, "doc_id", "left")
    state = F.struct(F.col("status").alias("status"), F.lit(None).cast("string").alias("decision"), F.col("unit").alias("unit"), F.lit(0).alias("corrections"), F.lit(0).alias("accepted"), F.array().cast("array<struct<action_id:bigint,reason:string>>").alias("rejected"))

    def step(s: Column, x: Column) -> Column:
        action, is_open = x["action"], s["status"].isin(OPEN)
        no_reason = action.isin(NEEDS_REASON) & (F.coalesce(F.trim(x["reason"]), F.lit("")) == "")
        bar = (
            F.when(~F.coalesce(x["role"].isin(APPROVERS), F.lit(False)), "yetki_yok").when(no_reason, "gerekce_yok").when(action.isin("onayla", "reddet") & ~is_open, "sonuclanmis")
            .when((action == "birim_degistir") & ~x["target"], "birim_gecersiz").when((action == "karari_geri_al") & (x["role"] != "yonetici"), "yalniz_yonetici").when((action == "karari_geri_al") & is_open, "acik")
            .when(~F.coalesce(action.isin(ACTIONS), F.lit(False)), "bilinmeyen")
        )
        ok = bar.isNull()
        status = F.when(action == "onayla", "onaylandi").when(action == "reddet", "reddedildi").when(action == "eksik_bilgi_iste", "eksik_bilgi_bekliyor").when(action.isin("eksik_bilgi_cevabi", "karari_geri_al"), "insan_onayi_bekliyor").otherwise(s["status"])
        decision = F.when(action == "onayla", "onaylandi").when(action == "reddet", "reddedildi").when(action == "birim_degistir", "birim_degistirildi").when(action == "eksik_bilgi_iste", "eksik_bilgi_istendi").when(action == "karari_geri_al", F.lit(None)).otherwise(s["decision"])
        corrected = action.isin(CORRECTS).cast("int")
        return F.struct(
            F.when(ok, status).otherwise(s["status"]).alias("status"), F.when(ok, decision).otherwise(s["decision"]).alias("decision"), F.when(ok & (action == "birim_degistir"), x["new_unit"]).otherwise(s["unit"]).alias("unit"),
            F.when(ok, s["corrections"] + corrected).otherwise(s["corrections"]).alias("corrections"), F.when(ok, s["accepted"] + 1).otherwise(s["accepted"]).alias("accepted"),
            F.when(ok, s["rejected"]).otherwise(F.array_append(s["rejected"], F.struct(x["action_id"].alias("action_id"), bar.alias("reason")))).alias("rejected"),
        )

    folded = F.aggregate(F.coalesce("a", F.array().cast("array<struct<ts:timestamp,action_id:bigint,role:string,action:string,reason:string,new_unit:string,target:boolean>>")), state, step)
    return both.select("doc_id", folded.alias("s")).select("doc_id", "s.status", "s.decision", "s.unit", "s.corrections", "s.accepted", "s.rejected")


def answers_close_gaps(missing: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing items with answers matched by their question (clipped, resolved), and doc_id, critical_left, status of the
    answered documents, which go back to the human queue."""
    given = answers.where(F.trim("answer") != "").groupBy("doc_id", "question").agg(F.min(F.substring(F.trim("answer"), 1, 1000)).alias("new_answer"))
    items = missing.join(given, ["doc_id", "question"], "left").withColumn("resolved", F.col("resolved") | F.col("new_answer").isNotNull())
    left = items.groupBy("doc_id").agg(F.sum(((F.col("severity") == "hata") & ~F.col("resolved")).cast("long")).alias("critical_left"), F.max(F.col("new_answer").isNotNull()).alias("answered")).where("answered")
    return items, left.select("doc_id", "critical_left", F.lit("insan_onayi_bekliyor").alias("status"))


def transfers(outgoing: DataFrame, recipients: DataFrame) -> DataFrame:
    """Incoming entries that approved replies make: one where the recipient is a unit of ours, none outside."""
    return outgoing.join(recipients.where("unit is not null"), "doc_id").select("doc_id", F.col("unit").alias("current_unit"), F.col("from_unit"), F.col("ts").alias("arrived"), F.lit(False).alias("registered"))
