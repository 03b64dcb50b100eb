"""Column alignment and mapping memory.

Proposals are keyed by source column name, as a batch of sources shares one
proposal. Mapping memory is a table keyed by schema fingerprint:
``(fingerprint, pos, source_col, to, confidence, rationale, confirmed,
confirmed_at)``. The dictionaries below are tiny fixed tables and are
broadcast; everything else is joins and partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_name
from tessera.operators.sizing import global_index, shuffled

# Bilingual synonym dictionary, normalized source name -> canonical field.
SYNONYMS: dict[str, str] = {
    # customer_name
    "customer": "customer_name", "customer_name": "customer_name",
    "cust": "customer_name", "cust_name": "customer_name",
    "client": "customer_name", "buyer": "customer_name",
    "客户": "customer_name", "客户名称": "customer_name",
    "客户姓名": "customer_name", "顾客": "customer_name", "买家": "customer_name",
    # order_date
    "order_date": "order_date", "date": "order_date",
    "purchased": "order_date", "date_purchased": "order_date",
    "purchase_date": "order_date", "order_time": "order_date",
    "日期": "order_date", "订单日期": "order_date", "下单日期": "order_date",
    "购买日期": "order_date", "成交日期": "order_date",
    # revenue
    "revenue": "revenue", "amount": "revenue", "amount_usd": "revenue",
    "revenue_usd": "revenue", "rev": "revenue", "sales": "revenue",
    "total": "revenue",
    "金额": "revenue", "收入": "revenue", "营收": "revenue",
    "销售额": "revenue", "成交金额": "revenue", "订单金额": "revenue",
    # email
    "email": "email", "e_mail": "email", "mail": "email",
    "邮箱": "email", "电子邮箱": "email", "电子邮件": "email",
    # phone
    "phone": "phone", "phone_number": "phone", "tel": "phone",
    "mobile": "phone", "电话": "phone", "手机": "phone",
    "手机号": "phone", "联系电话": "phone",
    # country
    "country": "country", "nation": "country", "region": "country",
    "国家": "country", "地区": "country", "国家地区": "country",
}

# Canonical field -> type and bilingual descriptions.
CANON_META: dict[str, dict] = {
    "customer_name": {"type": "VARCHAR", "desc_en": "Customer / buyer name", "desc_zh": "客户/买家名称"},
    "order_date": {"type": "DATE", "desc_en": "Date the order was placed", "desc_zh": "下单日期"},
    "revenue": {"type": "DECIMAL", "desc_en": "Order revenue amount", "desc_zh": "订单收入金额"},
    "email": {"type": "VARCHAR", "desc_en": "Customer email", "desc_zh": "客户邮箱"},
    "phone": {"type": "VARCHAR", "desc_en": "Customer phone", "desc_zh": "客户电话"},
    "country": {"type": "VARCHAR", "desc_en": "Country / region", "desc_zh": "国家/地区"},
}

# Proposal confidences and rationales.
SYNONYM_CONFIDENCE = 0.95
SYNONYM_RATIONALE = "dictionary match (zh/en synonym)"
MISS_RATIONALE = "no synonym match — needs human confirm"
RAW_RATIONALE = "raw column name (no mapping)"
BACKFILL_RATIONALE = "added so the column is not hidden"
LOW_CONFIDENCE = 0.6

PROPOSAL_SCHEMA = "source_col string, to string, confidence double, rationale string"


class MappingNotConfirmed(RuntimeError):
    pass


def synonyms_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SYNONYMS.items()), "norm string, canonical string")


def canon_meta_df(spark: SparkSession) -> DataFrame:
    rows = [(k, v["type"], v["desc_en"], v["desc_zh"]) for k, v in CANON_META.items()]
    return spark.createDataFrame(rows, "name string, type string, desc_en string, desc_zh string")


def _proposal(df: DataFrame, to, conf, why) -> DataFrame:
    return df.select(
        F.col("source_col"), to.cast("string").alias("to"),
        conf.cast("double").alias("confidence"), why.cast("string").alias("rationale"),
    )


# --- C6, C7 ----------------------------------------------------------------------

def propose_by_synonyms(catalog: DataFrame, per_source: bool = False) -> DataFrame:
    """Normalized name looked up in the synonym table (broadcast: 55 rows).

    Default: one row per distinct column name of the batch. ``per_source``
    keeps ``(source_id, pos)`` so every catalog row gets its own proposal.
    """
    spark = catalog.sparkSession
    keys = ["source_id", "pos", "name"] if per_source else ["name"]
    names = catalog.select(*keys).distinct() if not per_source else catalog.select(*keys)
    hit = names.withColumn("norm", normalize_name("name")).join(F.broadcast(synonyms_df(spark)), "norm", "left")
    out = hit.select(
        *[k for k in keys if k != "name"],
        F.col("name").alias("source_col"),
        F.col("canonical").alias("to"),
        F.when(F.col("canonical").isNotNull(), F.lit(SYNONYM_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("canonical").isNotNull(), F.lit(SYNONYM_RATIONALE)).otherwise(F.lit(MISS_RATIONALE)).alias("rationale"),
    )
    return out


def propose_raw(catalog: DataFrame) -> DataFrame:
    """Identity proposal: every distinct name maps to itself, confidence 1."""
    names = catalog.select(F.col("name").alias("source_col")).distinct()
    return _proposal(names, F.col("source_col"), F.lit(1.0), F.lit(RAW_RATIONALE))


def raw_canonical(catalog: DataFrame, source_order: str = "source_order") -> DataFrame:
    """Canonical fields of the identity proposal: one per distinct name, in
    first-seen order (source order, then column position), type of the first
    sighting, descriptions = the name."""
    first = F.struct(F.col(source_order), F.col("pos"))
    agg = catalog.groupBy("name").agg(F.min(first).alias("_first"), F.min_by("type", first).alias("type"))
    ordered = agg.select(F.col("_first")[source_order].alias("_o"), F.col("_first")["pos"].alias("_p"), "name", "type")
    return global_index(ordered, ["_o", "_p", "name"]).select(
        "pos", "name", F.coalesce("type", F.lit("VARCHAR")).alias("type"),
        F.col("name").alias("desc_en"), F.col("name").alias("desc_zh"),
    )


# --- C8, C9 ----------------------------------------------------------------------

def canonical_from_mapping(proposal: DataFrame) -> DataFrame:
    """Distinct canonical names in use, sorted, with their meta. A hand-typed name
    without meta is a VARCHAR field described by itself. The fields of one canonical
    schema (a table's columns) are ranked in one window."""
    used = proposal.where(F.col("to").isNotNull() & (F.col("to") != "")).select(F.col("to").alias("name")).distinct()
    known = used.join(F.broadcast(canon_meta_df(proposal.sparkSession)), "name", "left")
    return global_index(known, ["name"]).select("pos", "name", F.coalesce("type", F.lit("VARCHAR")).alias("type"),
                        F.coalesce("desc_en", "name").alias("desc_en"), F.coalesce("desc_zh", "name").alias("desc_zh"))


def join_canonical(fields: DataFrame, proposal: DataFrame) -> DataFrame:
    """The canonical table ``fields(pos, name, type, desc_en, desc_zh)`` with the
    targets of ``proposal`` that it lacks, each once, after its own fields in name
    order: dictionary names with their meta, hand-typed ones as VARCHAR."""
    old = fields.select("pos", "name", "type", "desc_en", "desc_zh")
    new = canonical_from_mapping(proposal).join(fields.select("name"), "name", "left_anti").drop("pos")
    top = fields.agg(F.max("pos")).first()[0]  # one number
    after = 0 if top is None else top + 1
    placed = global_index(new, ["name"]).withColumn("pos", F.col("pos") + F.lit(after))
    return old.unionByName(placed.select(*old.columns))


def enrich_canonical(fields: DataFrame) -> DataFrame:
    """Blank or missing type/descriptions filled from meta for known names."""
    spark = fields.sparkSession
    meta = F.broadcast(canon_meta_df(spark).select(
        "name", F.col("type").alias("_t"), F.col("desc_en").alias("_en"), F.col("desc_zh").alias("_zh")))
    j = fields.join(meta, "name", "left")

    def fill(c, m):
        return F.when((F.col(c).isNull() | (F.col(c) == "")) & F.col(m).isNotNull(), F.col(m)).otherwise(F.col(c)).alias(c)

    others = [c for c in fields.columns if c not in ("name", "type", "desc_en", "desc_zh")]
    return j.select(*others, "name", fill("type", "_t"), fill("desc_en", "_en"), fill("desc_zh", "_zh"))


# --- C10 -------------------------------------------------------------------------

def backfill_unmapped(proposal: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every source column name appears: absent ones are added unmapped."""
    names = catalog.select(F.col("name").alias("source_col")).distinct()
    missing = names.join(proposal.select("source_col"), "source_col", "left_anti")
    added = _proposal(missing, F.lit(None), F.lit(0.0), F.lit(BACKFILL_RATIONALE))
    return proposal.select("source_col", "to", "confidence", "rationale").unionByName(added)


# --- C12 -------------------------------------------------------------------------

def confirm_mapping(proposal: DataFrame, catalog: DataFrame, sources: DataFrame, memory: DataFrame | None = None,
                    confirmed_at=None) -> DataFrame:
    """Slice the confirmed proposal to each source's own columns and upsert it
    per fingerprint (the whole mapping of a fingerprint is replaced; when two
    sources of a batch share a fingerprint the later source's slice wins).

    ``sources(source_id, fingerprint, source_order)``; ``memory`` is the
    existing table (same schema as the result) or None.
    """
    at = F.lit(confirmed_at).cast("timestamp_ntz") if confirmed_at is not None else F.localtimestamp()
    winner = sources.groupBy("fingerprint").agg(F.max_by("source_id", "source_order").alias("source_id"))
    cols = shuffled(catalog).join(winner, "source_id").select("fingerprint", "pos", F.col("name").alias("source_col"))
    sliced = cols.join(proposal, "source_col").select(
        "fingerprint", F.col("pos").cast("int").alias("pos"), "source_col", "to",
        F.col("confidence").cast("double").alias("confidence"), "rationale",
        F.lit(True).alias("confirmed"), at.alias("confirmed_at"),
    )
    if memory is None:
        return sliced
    kept = memory.join(sliced.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return kept.unionByName(sliced)


# --- C11, C14, C15 ---------------------------------------------------------------

def _confirmed_per_source(sources: DataFrame, memory: DataFrame) -> DataFrame:
    flags = memory.groupBy("fingerprint").agg(F.every("confirmed").alias("_ok"))
    return sources.join(flags, "fingerprint", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))


def all_confirmed(sources: DataFrame, memory: DataFrame) -> bool:
    """Driver decision on a one-row aggregate: every source's fingerprint has a
    confirmed mapping (and the batch is not empty)."""
    r = _confirmed_per_source(sources, memory).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_ok")).alias("bad")).first()
    return r["n"] > 0 and r["bad"] == 0


def merged_mapping(sources: DataFrame, memory: DataFrame) -> DataFrame:
    """Per source column name the mapping of the latest source carrying it."""
    rows = sources.join(memory, "fingerprint")
    info = F.struct("to", "confidence", "rationale")
    return rows.groupBy("source_col").agg(F.max_by(info, F.struct("source_order", "pos")).alias("_m")).select(
        "source_col", F.col("_m.to").alias("to"), F.col("_m.confidence").alias("confidence"),
        F.col("_m.rationale").alias("rationale"))


def reuse_confirmed(sources: DataFrame, catalog: DataFrame, memory: DataFrame) -> DataFrame | None:
    """Mapping memory: when every source's fingerprint has a confirmed mapping,
    the merged mapping (later source wins) plus backfilled columns; else None
    (a fresh proposal is needed)."""
    if not all_confirmed(sources, memory):
        return None
    return backfill_unmapped(merged_mapping(sources, memory), catalog)


def _gate(sources: DataFrame, memory: DataFrame):
    """One aggregate job: (sources, unconfirmed sources, mapped columns)."""
    flags = memory.groupBy("fingerprint").agg(
        F.every("confirmed").alias("_ok"),
        F.count_if(F.col("to").isNotNull() & (F.col("to") != "")).alias("_mapped"))
    r = sources.join(flags, "fingerprint", "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(F.col("_ok"), F.lit(False))).alias("bad"),
        F.coalesce(F.sum("_mapped"), F.lit(0)).alias("mapped")).first()
    return r["n"], r["bad"], r["mapped"]


def flat_mapping(sources: DataFrame, memory: DataFrame, check: bool = True) -> DataFrame:
    """``source_col -> canonical`` over the confirmed mappings of all sources,
    NULL targets dropped, later source wins. ``ord`` is the entry's place: where the
    column was mapped first, by source and position. Raises when a source is
    unconfirmed or nothing is mapped (both decided by one aggregate)."""
    if check:
        n, bad, mapped = _gate(sources, memory)
        if n == 0 or bad:
            raise MappingNotConfirmed("mapping not confirmed for a source")
        if not mapped:
            raise MappingNotConfirmed("no confirmed column mappings")
    rows = sources.join(memory.where(F.col("to").isNotNull() & (F.col("to") != "")), "fingerprint")
    place = F.struct("source_order", "pos")
    return rows.groupBy("source_col").agg(F.max_by("to", place).alias("to"), F.min(place).alias("ord"))


def low_confidence(proposal: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    return proposal.where(F.col("confidence") < threshold)
