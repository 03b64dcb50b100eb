"""Registered queries for the schema catalog, mapping memory, plan compiler
and drift gate (C1-C16, O10, D1-D7), with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, norm_name_py, normalize_name
from tessera.operators import catalog as cat
from tessera.operators import drift
from tessera.operators import mapping as mp
from tessera.operators import ops
from tessera.operators.sizing import materialize, shuffled
from tessera.operators.unify import sheet_frame
from tessera.plans import frames as fr
from tessera.plans.oracle import (
    CUST, ORD,
    EV_CATALOG, EVENT_CELLS, PR_CATALOG, PRIORITY_CELLS, REQUIRED, SHEETS, fp_cte, norm, q, with_ctes,
)
from tessera.plans.registry import register

CONFIRMED_AT = "2024-01-01 00:00:00"


def _join_samples(df: DataFrame) -> DataFrame:
    return df.withColumn("samples", F.array_join("samples", "|"))


# --- Spark-side building blocks --------------------------------------------------

def sheet_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog of every customer sheet; small (files x columns), so it is
    materialized once for the several jobs that reuse it."""
    headers = fr.sheet_headers(spark, sf)
    c = cat.introspect_grid(fr.sheet_grid(spark, sf), headers.select("source_file", "header"))
    return materialize(c.join(shuffled(headers.select(F.col("source_file").alias("source_id"), "source_order")), "source_id"))


def sheet_sources(spark: SparkSession, sf: str, catalog: DataFrame | None = None) -> DataFrame:
    c = catalog if catalog is not None else sheet_catalog(spark, sf)
    orders = c.select("source_id", "source_order").distinct()
    return cat.fingerprints(c).join(shuffled(orders), "source_id")


def sheet_proposal(spark, sf, c=None):
    return mp.propose_by_synonyms(c if c is not None else sheet_catalog(spark, sf))


def sheet_confirmed_proposal(spark, sf, c):
    """The batch proposal a reviewer confirms: dictionary hits, every other
    column backfilled as unmapped."""
    hits = mp.propose_by_synonyms(c).where(F.col("to").isNotNull())
    return mp.backfill_unmapped(hits, c)


def sheet_memory(spark, sf, c=None):
    c = c if c is not None else sheet_catalog(spark, sf)
    return materialize(mp.confirm_mapping(sheet_confirmed_proposal(spark, sf, c), c, sheet_sources(spark, sf, c),
                                          confirmed_at=CONFIRMED_AT))


def sheet_canonical(spark, sf, c):
    return mp.canonical_from_mapping(mp.propose_by_synonyms(c))


def sheet_steps(spark, sf, c=None):
    c = c if c is not None else sheet_catalog(spark, sf)
    return ops.steps_table(sheet_memory(spark, sf, c), sheet_canonical(spark, sf, c))


def sheet_skills(spark, sf, c=None):
    folded = ops.fold_steps(sheet_steps(spark, sf, c))
    return folded.select(F.col("fingerprint").alias("skill_id"), F.concat(F.lit("auto-"), "fingerprint").alias("name"),
                         F.lit(1).alias("version"), "fingerprint", "steps")


# --- SQL-side building blocks ----------------------------------------------------

SYN = ("syn", "SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(mp.SYNONYMS.items()))
       + ") v(norm, canonical)")
META = ("meta", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(k)}, {q(v['type'])}, {q(v['desc_en'])}, {q(v['desc_zh'])})" for k, v in mp.CANON_META.items())
    + ") v(name, type, desc_en, desc_zh)")

_HIT = "CAST(0.95 AS DOUBLE)"
_MISS = "CAST(0.0 AS DOUBLE)"

PROP_SRC = ("prop_src", f"""
SELECT c.source_id, c.pos, c.name AS source_col, s.canonical AS "to",
  CASE WHEN s.canonical IS NOT NULL THEN {_HIT} ELSE {_MISS} END AS confidence,
  CASE WHEN s.canonical IS NOT NULL THEN {q(mp.SYNONYM_RATIONALE)} ELSE {q(mp.MISS_RATIONALE)} END AS rationale
FROM sheet_catalog c LEFT JOIN syn s ON s.norm = {norm('c.name')}""")

PROP = ("prop", f"""
SELECT DISTINCT c.name AS source_col, s.canonical AS "to",
  CASE WHEN s.canonical IS NOT NULL THEN {_HIT} ELSE {_MISS} END AS confidence,
  CASE WHEN s.canonical IS NOT NULL THEN {q(mp.SYNONYM_RATIONALE)} ELSE {q(mp.MISS_RATIONALE)} END AS rationale
FROM (SELECT DISTINCT name FROM sheet_catalog) c LEFT JOIN syn s ON s.norm = {norm('c.name')}""")

BACKFILLED = ("backfilled", f"""
SELECT source_col, "to", confidence, rationale FROM prop WHERE "to" IS NOT NULL
UNION ALL
SELECT DISTINCT name, CAST(NULL AS VARCHAR), {_MISS}, {q(mp.BACKFILL_RATIONALE)} FROM sheet_catalog
WHERE name NOT IN (SELECT source_col FROM prop WHERE "to" IS NOT NULL)""")

MEMORY = ("mem", f"""
SELECT w.fingerprint, c.pos, c.name AS source_col, b."to", b.confidence, b.rationale,
       TRUE AS confirmed, TIMESTAMP '{CONFIRMED_AT}' AS confirmed_at
FROM (SELECT fingerprint, arg_max(source_id, source_order) AS source_id FROM sheet_fp GROUP BY fingerprint) w
JOIN sheet_catalog c USING (source_id) JOIN backfilled b ON b.source_col = c.name""")

CANON = ("canon", """
SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS pos, name, type, desc_en, desc_zh
FROM (SELECT DISTINCT "to" AS name FROM prop WHERE "to" IS NOT NULL) JOIN meta USING (name)""")

STEPS = ("steps", """
SELECT fingerprint, op, "from", "to", "column", "type", "format",
       CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY phase, ord, "to" NULLS LAST, "column") AS INTEGER)
         AS step_no
FROM (
  SELECT fingerprint, 0 AS phase, pos AS ord, 'map_column' AS op, source_col AS "from", "to",
         CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS "type", CAST(NULL AS VARCHAR) AS "format"
  FROM mem WHERE confirmed AND "to" IS NOT NULL AND "to" <> ''
  UNION ALL
  SELECT p.fingerprint, 1, c.pos, CASE WHEN upper(c.type) = 'DATE' THEN 'parse_date' ELSE 'cast' END,
         CAST(NULL AS VARCHAR), CASE WHEN upper(c.type) = 'DATE' THEN c.name END, c.name,
         CASE WHEN upper(c.type) <> 'DATE' THEN upper(c.type) END,
         CASE WHEN upper(c.type) = 'DATE' THEN 'auto' END
  FROM (SELECT DISTINCT fingerprint, "to" AS name FROM mem WHERE confirmed AND "to" IS NOT NULL AND "to" <> '') p
  JOIN canon c USING (name)
  WHERE upper(c.type) IN ('DATE', 'DECIMAL', 'DOUBLE', 'INTEGER', 'BIGINT'))""")

SHEET_BASE = SHEETS + (SYN, META, PROP)


# --- C1 ---------------------------------------------------------------------------

@register("c1_introspect", with_ctes(*SHEETS, body="SELECT source_id, pos, name, type, samples FROM sheet_catalog"))
def c1_introspect(spark, sf):
    return _join_samples(sheet_catalog(spark, sf).drop("source_order"))


@register("c1_introspect_events", with_ctes(EVENT_CELLS, EV_CATALOG, body="SELECT * FROM ev_catalog"))
def c1_introspect_events(spark, sf):
    return _join_samples(cat.introspect_long(fr.event_cells(spark, sf)))


# --- C3, C4, C5 --------------------------------------------------------------------

@register("c3_fingerprint", with_ctes(*SHEETS, body="SELECT source_id, fingerprint FROM sheet_fp"))
def c3_fingerprint(spark, sf):
    return cat.fingerprints(sheet_catalog(spark, sf))


@register("c3_fingerprint_events", with_ctes(EVENT_CELLS, EV_CATALOG, fp_cte("fp", "ev_catalog"), body="SELECT * FROM fp"))
def c3_fingerprint_events(spark, sf):
    return cat.fingerprints(cat.introspect_long(fr.event_cells(spark, sf)))


@register("c3_fingerprint_priorities",
          with_ctes(PRIORITY_CELLS, PR_CATALOG, fp_cte("fp", "pr_catalog"), body="SELECT * FROM fp"))
def c3_fingerprint_priorities(spark, sf):
    return cat.fingerprints(cat.introspect_long(fr.priority_cells(spark, sf)))


@register("c4_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def c4_content_hash(spark, sf):
    return fr.table(spark, sf, "documents").select("doc_id", content_hash("text").alias("content_hash"))


SPLIT_DAY = "2024-01-16"


def _event_batches(spark, sf):
    fps = materialize(cat.fingerprints(cat.introspect_long(fr.event_cells(spark, sf))))
    day = F.substring_index("source_id", "_", -1)
    return fps.where(day >= SPLIT_DAY), fps.where(day < SPLIT_DAY)


_KNOWN_SQL = (EVENT_CELLS, EV_CATALOG, fp_cte("fp", "ev_catalog"),
              ("src", f"SELECT * FROM fp WHERE split_part(source_id, '_', 2) >= '{SPLIT_DAY}'"),
              ("memo", f"SELECT DISTINCT fingerprint FROM fp WHERE split_part(source_id, '_', 2) < '{SPLIT_DAY}'"),
              ("known", "SELECT s.source_id, s.fingerprint, (m.fingerprint IS NOT NULL) AS known "
                        "FROM src s LEFT JOIN memo m USING (fingerprint)"))


@register("c5_known_shapes", with_ctes(*_KNOWN_SQL, body="SELECT * FROM known"))
def c5_known_shapes(spark, sf):
    batch, earlier = _event_batches(spark, sf)
    return cat.known_shapes(batch, earlier.select("fingerprint"))


@register("c5_known_batch", with_ctes(*_KNOWN_SQL, body="""
SELECT count(*) AS n_sources, count(*) FILTER (WHERE known) AS n_known,
       (COALESCE(bool_and(known), FALSE) AND count(*) > 0) AS known_fingerprint FROM known"""))
def c5_known_batch(spark, sf):
    batch, earlier = _event_batches(spark, sf)
    return cat.batch_known(cat.known_shapes(batch, earlier.select("fingerprint")))


# --- C6-C12, C14-C16 ----------------------------------------------------------------

@register("c6_propose_by_synonyms", with_ctes(*SHEET_BASE, PROP_SRC, body="SELECT * FROM prop_src"))
def c6_propose_by_synonyms(spark, sf):
    return mp.propose_by_synonyms(sheet_catalog(spark, sf), per_source=True)


@register("c7_propose_raw", with_ctes(*SHEETS, body=f"""
SELECT DISTINCT name AS source_col, name AS "to", CAST(1.0 AS DOUBLE) AS confidence,
       {q(mp.RAW_RATIONALE)} AS rationale FROM sheet_catalog"""))
def c7_propose_raw(spark, sf):
    return mp.propose_raw(sheet_catalog(spark, sf))


@register("c7_raw_canonical", with_ctes(*SHEETS, body="""
SELECT CAST(row_number() OVER (ORDER BY source_order, pos) - 1 AS INTEGER) AS pos, name, type,
       name AS desc_en, name AS desc_zh
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source_order, pos) AS rn FROM sheet_catalog)
WHERE rn = 1"""))
def c7_raw_canonical(spark, sf):
    return mp.raw_canonical(sheet_catalog(spark, sf))


@register("c8_canonical_from_mapping", with_ctes(*SHEET_BASE, CANON, body="SELECT * FROM canon"))
def c8_canonical_from_mapping(spark, sf):
    return mp.canonical_from_mapping(mp.propose_by_synonyms(sheet_catalog(spark, sf)))


@register("c9_enrich_canonical", with_ctes(*SHEET_BASE, ("fields", f"""
SELECT DISTINCT COALESCE("to", {norm('source_col')}) AS name, '' AS type, '' AS desc_en, '' AS desc_zh FROM prop"""),
    body="""
SELECT f.name,
  CASE WHEN (f.type IS NULL OR f.type = '') AND m.type IS NOT NULL THEN m.type ELSE f.type END AS type,
  CASE WHEN (f.desc_en IS NULL OR f.desc_en = '') AND m.desc_en IS NOT NULL THEN m.desc_en ELSE f.desc_en END AS desc_en,
  CASE WHEN (f.desc_zh IS NULL OR f.desc_zh = '') AND m.desc_zh IS NOT NULL THEN m.desc_zh ELSE f.desc_zh END AS desc_zh
FROM fields f LEFT JOIN meta m USING (name)"""))
def c9_enrich_canonical(spark, sf):
    prop = mp.propose_by_synonyms(sheet_catalog(spark, sf))
    fields = prop.select(F.coalesce("to", normalize_name("source_col")).alias("name"),
                         F.lit("").alias("type"), F.lit("").alias("desc_en"), F.lit("").alias("desc_zh")).distinct()
    return mp.enrich_canonical(fields)


@register("c10_backfill_unmapped", with_ctes(*SHEET_BASE, BACKFILLED, body="SELECT * FROM backfilled"))
def c10_backfill_unmapped(spark, sf):
    c = sheet_catalog(spark, sf)
    return sheet_confirmed_proposal(spark, sf, c)


@register("c12_confirm_mapping", with_ctes(*SHEET_BASE, BACKFILLED, MEMORY, body="SELECT * FROM mem"))
def c12_confirm_mapping(spark, sf):
    return sheet_memory(spark, sf)


@register("c12_custom_target", with_ctes(*SHEET_BASE, CANON, ("mine", f"""
SELECT DISTINCT 'my_' || {norm('name')} AS name FROM sheet_catalog
WHERE {norm('name')} NOT IN (SELECT norm FROM syn)"""), body="""
SELECT * FROM canon
UNION ALL
SELECT CAST((SELECT count(*) FROM canon) + row_number() OVER (ORDER BY encode(name)) - 1 AS INTEGER), name, 'VARCHAR', name, name FROM mine"""))
def c12_custom_target(spark, sf):
    """Columns without a synonym get a hand-typed target; the canonical table gains
    each such field once, as VARCHAR after its own fields."""
    prop = mp.propose_by_synonyms(sheet_catalog(spark, sf))
    fields = mp.canonical_from_mapping(prop)
    typed = prop.withColumn("to", F.coalesce("to", F.concat(F.lit("my_"), normalize_name("source_col"))))
    return mp.join_canonical(fields, typed)


@register("c11_reuse_confirmed", with_ctes(*SHEET_BASE, BACKFILLED, MEMORY, ("merged", """
SELECT source_col, arg_max({'to': "to", 'c': confidence, 'r': rationale}, (source_order, pos)) AS m
FROM sheet_fp JOIN mem USING (fingerprint) GROUP BY source_col"""), body=f"""
SELECT source_col, m['to'] AS "to", m['c'] AS confidence, m['r'] AS rationale FROM merged
UNION ALL
SELECT DISTINCT name, CAST(NULL AS VARCHAR), {_MISS}, {q(mp.BACKFILL_RATIONALE)} FROM sheet_catalog
WHERE name NOT IN (SELECT source_col FROM merged)"""))
def c11_reuse_confirmed(spark, sf):
    c = sheet_catalog(spark, sf)
    reused = mp.reuse_confirmed(sheet_sources(spark, sf, c), c, sheet_memory(spark, sf, c))
    if reused is None:
        return spark.createDataFrame([], mp.PROPOSAL_SCHEMA)
    return reused


@register("c14_flat_mapping", with_ctes(*SHEET_BASE, BACKFILLED, MEMORY, body="""
SELECT source_col, arg_max("to", (source_order, pos)) AS "to",
       arg_min(source_order, (source_order, pos)) AS first_source, arg_min(pos, (source_order, pos)) AS first_pos
FROM sheet_fp JOIN mem USING (fingerprint) WHERE "to" IS NOT NULL AND "to" <> '' GROUP BY source_col"""))
def c14_flat_mapping(spark, sf):
    """The entry's place (where its column was mapped first) is part of the result: it
    decides which column wins a field."""
    c = sheet_catalog(spark, sf)
    flat = mp.flat_mapping(sheet_sources(spark, sf, c), sheet_memory(spark, sf, c))
    return flat.select("source_col", "to", F.col("ord.source_order").alias("first_source"), F.col("ord.pos").alias("first_pos"))


@register("c15_low_confidence", with_ctes(*SHEET_BASE, PROP_SRC, body="SELECT * FROM prop_src WHERE confidence < 0.6"))
def c15_low_confidence(spark, sf):
    return mp.low_confidence(mp.propose_by_synonyms(sheet_catalog(spark, sf), per_source=True))


@register("c16_column_origins", with_ctes(*SHEETS, body="""
SELECT p.name, p.source_id, n.n_files FROM (SELECT DISTINCT name, source_id FROM sheet_catalog) p
JOIN (SELECT name, count(DISTINCT source_id) AS n_files FROM sheet_catalog GROUP BY name) n USING (name)"""))
def c16_column_origins(spark, sf):
    return cat.column_origins(sheet_catalog(spark, sf))


# --- C13 ---------------------------------------------------------------------------

_SKILL_LOG = ("skill_log", """
SELECT o_orderkey AS id, o_orderpriority AS name, CAST(year(o_orderdate) - 1994 AS INTEGER) AS version FROM orders""")


def _skill_log(spark, sf):
    o = fr.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
                    (F.year("o_orderdate") - 1994).cast("int").alias("version"))


@register("c13_next_version", with_ctes(_SKILL_LOG, body="""
SELECT name, CAST(COALESCE(max(version), 0) + 1 AS INTEGER) AS next_version FROM skill_log GROUP BY name"""))
def c13_next_version(spark, sf):
    return cat.next_version(_skill_log(spark, sf), ["name"])


@register("c13_latest_version", with_ctes(_SKILL_LOG, body="""
SELECT name, id, version FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC, id DESC) AS rn
FROM skill_log) WHERE rn = 1"""))
def c13_latest_version(spark, sf):
    return cat.latest_version(_skill_log(spark, sf), ["name"])


@register("c13_append_versions", with_ctes(_SKILL_LOG, ("old", "SELECT * FROM skill_log WHERE id % 3 = 0"), ("new", """
SELECT id, name FROM skill_log WHERE id % 3 <> 0"""), body="""
SELECT n.id, n.name, CAST(COALESCE(o.top, 0) + row_number() OVER (PARTITION BY n.name ORDER BY n.id) AS INTEGER) AS version
FROM new n LEFT JOIN (SELECT name, max(version) AS top FROM old GROUP BY name) o USING (name)"""))
def c13_append_versions(spark, sf):
    """A batch of new skills of five names: each name's versions go on after its highest."""
    log = _skill_log(spark, sf)
    new = log.where("id % 3 <> 0").select("id", "name")
    return cat.append_versions(log.where("id % 3 = 0"), new).select("id", "name", "version")


# --- O10, D1, D7 --------------------------------------------------------------------

_STEP_SQL = SHEET_BASE + (BACKFILLED, MEMORY, CANON, STEPS)


@register("o10_steps_from_mapping", with_ctes(*_STEP_SQL, body="SELECT * FROM steps"))
def o10_steps_from_mapping(spark, sf):
    return sheet_steps(spark, sf).select("fingerprint", "op", "from", "to", "column", "type", "format",
                                         F.col("step_no").cast("int").alias("step_no"))


@register("d1_required_columns", with_ctes(*_STEP_SQL, body="""
SELECT fingerprint AS skill_id, CAST(step_no - 1 AS INTEGER) AS pos, "from" AS name FROM steps WHERE op = 'map_column'"""))
def d1_required_columns(spark, sf):
    return drift.required_columns(sheet_skills(spark, sf))


@register("d7_match_skills", with_ctes(*_STEP_SQL, body="""
SELECT s.source_id, s.fingerprint, 'auto-' || s.fingerprint AS skill_name
FROM sheet_fp s JOIN (SELECT DISTINCT fingerprint FROM steps) k USING (fingerprint)"""))
def d7_match_skills(spark, sf):
    c = sheet_catalog(spark, sf)
    m = cat.match_skills(sheet_sources(spark, sf, c), sheet_skills(spark, sf, c))
    return m.select("source_id", "fingerprint", F.col("name").alias("skill_name"))


@register("d7_match_classes", with_ctes(*_STEP_SQL, body="""
SELECT s.fingerprint, count(*) AS n_sources, CAST(1 AS BIGINT) AS n_skills, min(s.source_id) AS first_source, max(s.source_id) AS last_source
FROM sheet_fp s WHERE s.fingerprint IN (SELECT fingerprint FROM steps) GROUP BY s.fingerprint"""))
def d7_match_classes(spark, sf):
    """Matches as classes and members: rows grow with sources and skills, not with their pairs."""
    c = sheet_catalog(spark, sf)
    classes, members = cat.match_classes(sheet_sources(spark, sf, c), sheet_skills(spark, sf, c))
    sides = members.where("side = 'source'").groupBy("fingerprint").agg(F.min("member").alias("first_source"), F.max("member").alias("last_source"))
    return classes.join(sides, "fingerprint").select("fingerprint", "n_sources", "n_skills", "first_source", "last_source")


# --- D2, D3 -------------------------------------------------------------------------

def _drift_reports(spark, sf):
    ev = cat.introspect_long(fr.event_cells(spark, sf))
    pr = cat.introspect_long(fr.priority_cells(spark, sf))
    req = spark.createDataFrame(
        [(1, i, n) for i, n in enumerate(fr.EVENT_REQUIRED)] + [(2, i, n) for i, n in enumerate(fr.PRIORITY_REQUIRED)],
        "skill_id long, pos int, name string")
    inc = ev.select("source_id", "pos", "name").unionByName(pr.select("source_id", "pos", "name"))
    pairs = (ev.select(F.lit(1).cast("long").alias("skill_id"), "source_id").distinct()
             .unionByName(pr.select(F.lit(2).cast("long").alias("skill_id"), "source_id").distinct()))
    return drift.classify_drift(pairs, req, inc)


_DRIFT_SQL = (EVENT_CELLS, EV_CATALOG, PRIORITY_CELLS, PR_CATALOG, REQUIRED, ("pairs", """
SELECT DISTINCT CAST(1 AS BIGINT) AS skill_id, source_id FROM ev_catalog
UNION ALL SELECT DISTINCT CAST(2 AS BIGINT), source_id FROM pr_catalog"""), ("inc", """
SELECT source_id, pos, name FROM ev_catalog UNION ALL SELECT source_id, pos, name FROM pr_catalog"""), ("reqn", f"""
SELECT skill_id, nrm, arg_max(name, pos) AS name, min(pos) AS pos
FROM (SELECT *, {norm('name')} AS nrm FROM req) GROUP BY skill_id, nrm"""), ("incn", f"""
SELECT source_id, nrm, arg_max(name, pos) AS i_name, min(pos) AS i_pos
FROM (SELECT *, {norm('name')} AS nrm FROM inc) GROUP BY source_id, nrm"""), ("rp", """
SELECT p.skill_id, p.source_id, r.nrm, r.name AS r_name, r.pos AS r_pos FROM pairs p JOIN reqn r USING (skill_id)"""),
    ("ip", "SELECT p.skill_id, p.source_id, i.nrm, i.i_name, i.i_pos FROM pairs p JOIN incn i USING (source_id)"),
    ("both_sides", "SELECT * FROM rp FULL OUTER JOIN ip USING (skill_id, source_id, nrm)"), ("per", """
SELECT skill_id, source_id,
  count(*) FILTER (WHERE i_name IS NULL) AS nm, count(*) FILTER (WHERE r_name IS NULL) AS ne,
  COALESCE(string_agg(CASE WHEN i_name IS NULL THEN r_name END, '|' ORDER BY r_pos), '') AS missing,
  COALESCE(string_agg(CASE WHEN r_name IS NULL THEN i_name END, '|' ORDER BY i_pos), '') AS extra
FROM both_sides GROUP BY skill_id, source_id"""), ("rep", """
SELECT skill_id, source_id,
  CASE WHEN nm = 0 AND ne = 0 THEN 'exact' WHEN nm = 0 THEN 'mappable' WHEN ne >= nm THEN 'mappable'
       ELSE 'unmappable' END AS kind, missing, extra FROM per"""))


@register("d2_classify_drift", with_ctes(*_DRIFT_SQL, body="""
SELECT skill_id, source_id, kind, missing, CASE WHEN kind <> 'unmappable' THEN extra END AS extra FROM rep"""))
def d2_classify_drift(spark, sf):
    r = _drift_reports(spark, sf)
    return r.select("skill_id", "source_id", "kind", F.array_join("missing", "|").alias("missing"),
                    F.array_join("extra", "|").alias("extra"))


@register("d3_worst_drift", with_ctes(*_DRIFT_SQL, body="""
SELECT skill_id,
  CASE max(CASE kind WHEN 'unmappable' THEN 2 WHEN 'mappable' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'unmappable' WHEN 1 THEN 'mappable' ELSE 'exact' END AS worst,
  count(*) FILTER (WHERE kind = 'exact') AS n_exact, count(*) FILTER (WHERE kind = 'mappable') AS n_mappable,
  count(*) FILTER (WHERE kind = 'unmappable') AS n_unmappable
FROM rep GROUP BY skill_id"""))
def d3_worst_drift(spark, sf):
    return drift.worst_drift(_drift_reports(spark, sf), ["skill_id"])


# --- D4, D5, D6 on the per-customer sheets -----------------------------------------

def _sheet0_skill() -> list[dict]:
    """Skill saved from the first sheet (customer 0): renames by the dictionary,
    then the typed casts of the canonical fields."""
    names = [sp[0] for sp in fr.SHEET_SPELLINGS]
    mapping = {n: {"to": mp.SYNONYMS.get(norm_name_py(n))} for n in names}
    canon = [{"name": k, **v} for k, v in sorted(mp.CANON_META.items())]
    return ops.steps_from_mapping(mapping, canon)


def _sheet_drift(spark, sf, c):
    steps = _sheet0_skill()
    return steps, drift.classify_drift_one([s["from"] for s in steps if s["op"] == "map_column"], c)


_SHEET0 = [sp[0] for sp in fr.SHEET_SPELLINGS]
_REQ_NORMS = sorted({norm_name_py(n) for n in _SHEET0})

_EXACT_SQL = ("exact_src", f"""
SELECT source_id FROM sheet_catalog GROUP BY source_id
HAVING list_sort(list_distinct(list({norm('name')}))) = [{", ".join(q(n) for n in _REQ_NORMS)}]""")


def _wide_sql(src_cte: str) -> tuple[str, str]:
    cols = ", ".join(
        f"max(CASE WHEN {norm('h.name')} = {q(norm_py)} THEN v.value END) AS {q(orig).replace(chr(39), chr(34))}"
        for orig, norm_py in zip(_SHEET0, [norm_name_py(n) for n in _SHEET0]))
    return ("wide", f"""
SELECT v.source_id AS source_file, v.row_no, {cols}
FROM sheet_cells v JOIN sheet_cols h USING (source_id, pos)
WHERE v.source_id IN (SELECT source_id FROM {src_cte}) GROUP BY v.source_id, v.row_no""")


@register("d4_apply_skill", with_ctes(*SHEETS, _EXACT_SQL, _wide_sql("exact_src"), body="""
SELECT "Cust Name" AS customer_name, TRY_CAST("Date Purchased" AS DATE) AS order_date,
       TRY_CAST("Amount USD" AS DECIMAL(18,3)) AS revenue, "Email" AS email, "Phone" AS phone,
       "Country" AS country, source_file FROM wide"""))
def d4_apply_skill(spark, sf):
    """Replay the saved skill on every sheet whose drift verdict is exact, in one
    job over the grid (no per-file plan)."""
    c = sheet_catalog(spark, sf)
    steps, reports = _sheet_drift(spark, sf, c)
    exact = reports.where(F.col("kind") == drift.EXACT).select(F.col("source_id").alias("source_file"))
    grid = fr.sheet_grid(spark, sf).join(exact, "source_file", "left_semi")
    headers = fr.sheet_headers(spark, sf).join(exact, "source_file", "left_semi")
    wide = sheet_frame(grid, headers, _SHEET0)
    return ops.apply_steps(wide, steps, scope="source_file")


_ORDER_SKILL = [{"op": "map_column", "from": "Customer", "to": "customer_name"}, {"op": "map_column", "from": "Order Date", "to": "order_date"},
                {"op": "map_column", "from": "Revenue USD", "to": "revenue"}, {"op": "map_column", "from": "Status", "to": "status"},
                {"op": "parse_date", "column": "order_date", "to": "order_date", "format": "auto"}, {"op": "cast", "column": "revenue", "type": "DECIMAL"}]


def _gate(spark, frames: list) -> dict:
    """The saved order skill put to a batch of exports."""
    catalog = frames[0][1].transform(lambda df: cat.introspect(df))
    for _, df in frames[1:]:
        catalog = catalog.unionByName(cat.introspect(df))
    return drift.apply_skill(_ORDER_SKILL, frames, catalog)


@register("d4_apply_skill_ok", with_ctes(ORD, body="""
SELECT "Customer" AS customer_name, TRY_CAST("Order Date" AS DATE) AS order_date, TRY_CAST("Revenue USD" AS DECIMAL(18,3)) AS revenue,
       "Status" AS status, source_file FROM ord"""))
def d4_apply_skill_ok(spark, sf):
    """Five order exports, all as the skill expects: replayed."""
    out = _gate(spark, [("orders", fr.order_exports(spark, sf))])
    return out["result"]


@register("d4_apply_skill_mappable", with_ctes(CUST, ORD, SYN, body=f"""
SELECT n.name AS source_col, s.canonical AS "to", CASE WHEN s.canonical IS NULL THEN {_MISS} ELSE {_HIT} END AS confidence,
  CASE WHEN s.canonical IS NULL THEN {q(mp.MISS_RATIONALE)} ELSE {q(mp.SYNONYM_RATIONALE)} END AS rationale
FROM (SELECT column_name AS name FROM (DESCRIBE cust) UNION SELECT column_name FROM (DESCRIBE ord)) n
LEFT JOIN syn s ON s.norm = {norm('n.name')} WHERE n.name <> 'source_file'"""))
def d4_apply_skill_mappable(spark, sf):
    """One export of the batch has other names, as many as are missing: the batch is
    not replayed, and gets a fresh alignment."""
    out = _gate(spark, [("orders", fr.order_exports(spark, sf)), (fr.CUSTOMER_FILE, fr.customer_export(spark, sf))])
    return out["proposed_mapping"]


@register("d4_apply_skill_unmappable", with_ctes(CUST, ORD, body="""
SELECT DISTINCT source_file AS source_id, 'exact' AS kind, '' AS missing FROM ord
UNION ALL
SELECT DISTINCT source_file, 'unmappable', 'Customer|Order Date|Revenue USD|Status' FROM cust"""))
def d4_apply_skill_unmappable(spark, sf):
    """One export of the batch has too few columns: only the reports are given."""
    narrow = fr.customer_export(spark, sf).select("Cust Name", "source_file")
    out = _gate(spark, [("orders", fr.order_exports(spark, sf)), (fr.CUSTOMER_FILE, narrow)])
    return out["drift"].select("source_id", "kind", F.array_join("missing", "|").alias("missing"))


@register("d6_remap_skill_batch", with_ctes(CUST, body="""
SELECT "Cust Name" AS customer_name, TRY_CAST("Date Purchased" AS DATE) AS order_date, TRY_CAST("Amount USD" AS DECIMAL(18,3)) AS revenue,
       "Country" AS country, "Phone" AS phone, "Segment", source_file FROM cust"""))
def d6_remap_skill_batch(spark, sf):
    """The drifted export's confirmed alignment replaces the skill's renames; replayed."""
    export = fr.customer_export(spark, sf)
    catalog = cat.introspect(export)
    out = drift.remap_skill(_ORDER_SKILL, drift.propose_remap(catalog), [(fr.CUSTOMER_FILE, export)], catalog)
    return out["result"]


_MAPPABLE_SQL = ("mappable_src", f"""
SELECT source_id FROM sheet_catalog GROUP BY source_id
HAVING list_sort(list_distinct(list({norm('name')}))) <> [{", ".join(q(n) for n in _REQ_NORMS)}]""")


@register("d5_propose_remap", with_ctes(*SHEETS, SYN, _MAPPABLE_SQL, body=f"""
SELECT DISTINCT c.name AS source_col, s.canonical AS "to",
  CASE WHEN s.canonical IS NOT NULL THEN {_HIT} ELSE {_MISS} END AS confidence,
  CASE WHEN s.canonical IS NOT NULL THEN {q(mp.SYNONYM_RATIONALE)} ELSE {q(mp.MISS_RATIONALE)} END AS rationale
FROM (SELECT DISTINCT name FROM sheet_catalog WHERE source_id IN (SELECT source_id FROM mappable_src)) c
LEFT JOIN syn s ON s.norm = {norm('c.name')}"""))
def d5_propose_remap(spark, sf):
    """Drifted (mappable) sheets of the batch get a fresh alignment."""
    c = sheet_catalog(spark, sf)
    _, reports = _sheet_drift(spark, sf, c)
    drifted = reports.where(F.col("kind") == drift.MAPPABLE).select("source_id")
    return drift.propose_remap(c.join(drifted, "source_id", "left_semi"))


@register("d6_remap_skill", with_ctes(*SHEETS, SYN, _MAPPABLE_SQL, ("rp", f"""
SELECT c.source_id, c.pos, s.canonical AS field FROM sheet_catalog c JOIN syn s ON s.norm = {norm('c.name')}
WHERE c.source_id IN (SELECT source_id FROM mappable_src)"""), ("pick", """
SELECT source_id, field, min(pos) AS pos FROM rp GROUP BY source_id, field"""), ("cells", """
SELECT v.source_id, v.row_no, p.field, v.value FROM sheet_cells v JOIN pick p USING (source_id, pos)"""), body="""
SELECT max(CASE WHEN field = 'country' THEN value END) AS country,
       max(CASE WHEN field = 'customer_name' THEN value END) AS customer_name,
       max(CASE WHEN field = 'email' THEN value END) AS email,
       TRY_CAST(max(CASE WHEN field = 'order_date' THEN value END) AS DATE) AS order_date,
       max(CASE WHEN field = 'phone' THEN value END) AS phone,
       TRY_CAST(max(CASE WHEN field = 'revenue' THEN value END) AS DECIMAL(18,3)) AS revenue,
       source_id AS source_file
FROM cells GROUP BY source_id, row_no"""))
def d6_remap_skill(spark, sf):
    """Remap closes the loop for every drifted sheet at once: the confirmed
    proposal replaces the renames (per file, by position: the grid path), the
    skill's other steps are replayed on the canonical columns."""
    c = sheet_catalog(spark, sf)
    steps, reports = _sheet_drift(spark, sf, c)
    drifted = reports.where(F.col("kind") == drift.MAPPABLE).select(F.col("source_id").alias("source_file"))
    proposal = drift.propose_remap(c.join(drifted.withColumnRenamed("source_file", "source_id"), "source_id",
                                          "left_semi"))
    mapping = proposal.where(F.col("to").isNotNull()).select("source_col", "to", F.lit(0).alias("ord"))
    new_steps = drift.remap_steps(steps, [])
    grid = fr.sheet_grid(spark, sf).join(drifted, "source_file", "left_semi")
    headers = fr.sheet_headers(spark, sf).join(drifted, "source_file", "left_semi").select("source_file", "header")
    from tessera.operators.unify import unify_grid

    fields = sorted(mp.CANON_META)
    return ops.apply_steps(unify_grid(grid, headers, mapping, fields), new_steps, scope="source_file")
