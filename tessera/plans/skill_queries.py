"""Registered queries for skills as data: the drift gate, remap, run log and mapping memory
over one skill for every second customer sheet (C12, D4, D6), with their DuckDB twins.

Of each two runs of ``gap`` customer sheets, those of the first save a skill each; the sheet
``gap`` further on is the skill's new file. So there are half as many skills as customers.
The next sheet (gap 1) mostly has other header spellings, the 35th has the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as cat
from tessera.operators import commits, drift
from tessera.operators import mapping as mp
from tessera.operators.fold import wide
from tessera.operators.sizing import materialize, shuffled
from tessera.plans import frames as fr
from tessera.plans.catalog_queries import (
    BACKFILLED, CANON, CONFIRMED_AT, MEMORY, SHEET_BASE, STEPS, sheet_catalog, sheet_confirmed_proposal, sheet_skills, sheet_sources,
)
from tessera.plans.oracle import norm, with_ctes
from tessera.plans.registry import register
from tessera.plans.scan_queries import export_dir

FIELDS = sorted(mp.CANON_META)


class Batch:
    """Skills, their new sources and the sheets' grid."""

    def __init__(self, spark, sf, gap: int = 1):
        self.catalog = sheet_catalog(spark, sf)
        self.sources = materialize(sheet_sources(spark, sf, self.catalog))
        folded = sheet_skills(spark, sf, self.catalog).select("fingerprint", "steps")
        saved = self.sources.where(f"source_order div {gap} % 2 = 0").select(F.col("source_order").alias("skill_id"), "fingerprint")
        self.skills = materialize(saved.join(shuffled(folded), "fingerprint").select("skill_id", "fingerprint", "steps"))
        new = self.sources.where(f"source_order div {gap} % 2 = 1")
        self.pairs = new.select((F.col("source_order") - gap).alias("skill_id"), F.col("source_id").alias("source_file"), "source_order")
        self.headers = fr.sheet_headers(spark, sf).select("source_file", "header")
        self.grid = fr.sheet_grid(spark, sf)

    def gate(self, **options) -> dict:
        return drift.apply_skills(self.skills, self.grid, self.headers, self.pairs, **options)

    def remap(self, **options) -> dict:
        """All mappable skills get the reviewed alignment."""
        verdicts = self.gate()["verdicts"].where(F.col("worst") == drift.MAPPABLE)
        pairs = self.pairs.join(shuffled(verdicts), "skill_id", "left_semi")
        mapping = mp.propose_by_synonyms(self.catalog).where(F.col("to").isNotNull())
        names = self.catalog.join(shuffled(pairs.select(F.col("source_file").alias("source_id"))), "source_id", "left_semi")
        return drift.remap_skills(self.skills, mp.backfill_unmapped(mapping, names), self.grid, self.headers, pairs,
                                  confirmed_at=CONFIRMED_AT, **options)


def _base(gap: int) -> tuple:
    return SHEET_BASE + (BACKFILLED, MEMORY, CANON, STEPS, ("pair", f"""
SELECT o.source_order AS skill_id, n.source_id, o.fingerprint AS old_fp, n.fingerprint AS new_fp
FROM sheet_fp n JOIN sheet_fp o ON o.source_order = n.source_order - {gap} WHERE (n.source_order // {gap}) % 2 = 1"""), ("wanted", f"""
SELECT p.skill_id, {norm('s."from"')} AS nrm, arg_max(s."from", s.step_no) AS name, min(s.step_no) AS place
FROM pair p JOIN steps s ON s.fingerprint = p.old_fp WHERE s.op = 'map_column' GROUP BY ALL"""), ("held", f"""
SELECT p.skill_id, {norm('c.name')} AS nrm, arg_max(c.name, c.pos) AS name, min(c.pos) AS place
FROM pair p JOIN sheet_catalog c USING (source_id) GROUP BY ALL"""), ("sides", """
SELECT COALESCE(w.skill_id, h.skill_id) AS skill_id, w.name AS w_name, w.place AS w_place, h.name AS h_name, h.place AS h_place
FROM wanted w FULL OUTER JOIN held h ON w.skill_id = h.skill_id AND w.nrm = h.nrm"""), ("kinds", """
SELECT skill_id, CASE WHEN nm = 0 AND ne = 0 THEN 'exact' WHEN nm = 0 OR ne >= nm THEN 'mappable' ELSE 'unmappable' END AS kind, missing, extra
FROM (SELECT skill_id, count(*) FILTER (WHERE h_name IS NULL) AS nm, count(*) FILTER (WHERE w_name IS NULL) AS ne,
        COALESCE(string_agg(CASE WHEN h_name IS NULL THEN w_name END, '|' ORDER BY w_place), '') AS missing,
        COALESCE(string_agg(CASE WHEN w_name IS NULL THEN h_name END, '|' ORDER BY h_place), '') AS extra
      FROM sides GROUP BY skill_id)"""))


_BASE = _base(1)


def _replayed(gap: int, kind: str, columns: str) -> str:
    """Rows of all pairs of a kind: ``columns`` picks the cell of each field; a field that
    the skill casts or parses is rendered in its type, and a pair whose skill casts a field
    that its file does not give has no rows."""
    typed = {"order_date": "CAST(TRY_CAST({} AS DATE) AS VARCHAR)", "revenue": "CAST(TRY_CAST({} AS DECIMAL(18,3)) AS VARCHAR)"}
    value = lambda f: f"max(CASE WHEN field = '{f}' THEN value END)"
    out = [f"CASE WHEN bool_or(has_{f}) THEN {typed[f].format(value(f))} ELSE {value(f)} END AS {f}" if f in typed else f"{value(f)} AS {f}"
           for f in FIELDS]
    return with_ctes(*_base(gap), ("pick", columns), ("typed", """
SELECT p.skill_id, bool_or(s."column" = 'order_date') AS has_order_date, bool_or(s."column" = 'revenue') AS has_revenue
FROM pair p JOIN steps s ON s.fingerprint = p.old_fp WHERE s.op <> 'map_column' GROUP BY p.skill_id"""), ("lacking", """
SELECT DISTINCT p.skill_id FROM pair p JOIN steps s ON s.fingerprint = p.old_fp
WHERE s.op <> 'map_column' AND NOT EXISTS (SELECT 1 FROM pick k WHERE k.skill_id = p.skill_id AND k.field = s."column")"""), ("cells", f"""
SELECT p.skill_id, p.source_id, v.row_no, k.field, v.value, COALESCE(t.has_order_date, FALSE) AS has_order_date, COALESCE(t.has_revenue, FALSE) AS has_revenue
FROM pair p JOIN kinds d USING (skill_id) JOIN sheet_cells v USING (source_id)
LEFT JOIN pick k ON k.skill_id = p.skill_id AND k.pos = v.pos LEFT JOIN typed t ON t.skill_id = p.skill_id
WHERE d.kind = '{kind}' AND p.skill_id NOT IN (SELECT skill_id FROM lacking)"""),
        body=f"SELECT skill_id, source_id AS source_file, {', '.join(out)} FROM cells GROUP BY skill_id, source_id, row_no")


_BY_NAME = f"""
SELECT p.skill_id, s."to" AS field, min(c.pos) AS pos FROM pair p JOIN steps s ON s.fingerprint = p.old_fp AND s.op = 'map_column'
JOIN sheet_catalog c ON c.source_id = p.source_id AND {norm('c.name')} = {norm('s."from"')} GROUP BY ALL"""
_BY_DICTIONARY = f"""
SELECT p.skill_id, s.canonical AS field, min(c.pos) AS pos FROM pair p JOIN sheet_catalog c USING (source_id)
JOIN syn s ON s.norm = {norm('c.name')} GROUP BY ALL"""


def _texts(rows):
    return wide(rows, {f: "VARCHAR" for f in FIELDS}).select("skill_id", "source_file", *FIELDS)


@register("d4_skill_verdicts", with_ctes(*_BASE, body="SELECT skill_id, kind, missing, extra FROM (SELECT skill_id, kind, missing, CASE WHEN kind <> 'unmappable' THEN extra END AS extra FROM kinds)"))
def d4_skill_verdicts(spark, sf):
    """Every skill's drift against its new file."""
    r = Batch(spark, sf).gate()["drift"]
    return r.select("skill_id", "kind", F.array_join("missing", "|").alias("missing"), F.array_join("extra", "|").alias("extra"))


@register("d4_apply_skills", _replayed(35, "exact", _BY_NAME))
def d4_apply_skills(spark, sf):
    """All skills whose new file is as they expect, replayed in one job."""
    return _texts(Batch(spark, sf, gap=35).gate()["result"])


@register("d6_remap_skills", _replayed(1, "mappable", _BY_DICTIONARY))
def d6_remap_skills(spark, sf):
    """All drifted skills rewritten from the reviewed alignment, and replayed in one job."""
    return _texts(Batch(spark, sf).remap()["result"])


@register("d6_remap_skills_steps", with_ctes(*_BASE, ("renames", f"""
SELECT p.skill_id, p.new_fp, 0 AS phase, c.pos AS ord, 'map_column' AS op, c.name AS "from", s.canonical AS "to",
       CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS "type", CAST(NULL AS VARCHAR) AS "format"
FROM pair p JOIN kinds d USING (skill_id) JOIN sheet_catalog c USING (source_id) JOIN syn s ON s.norm = {norm('c.name')} WHERE d.kind = 'mappable'"""),
    ("kept", """
SELECT p.skill_id, p.new_fp, 1, s.step_no, s.op, s."from", s."to", s."column", s."type", s."format"
FROM pair p JOIN kinds d USING (skill_id) JOIN steps s ON s.fingerprint = p.old_fp WHERE d.kind = 'mappable' AND s.op <> 'map_column'"""), body="""
SELECT skill_id, new_fp AS fingerprint, CAST(row_number() OVER (PARTITION BY skill_id ORDER BY phase, ord) AS INTEGER) AS step_no,
       op, "from", "to", "column", "type", "format" FROM (SELECT * FROM renames UNION ALL SELECT * FROM kept)"""))
def d6_remap_skills_steps(spark, sf):
    """The rewritten steps and fingerprints, as they are read back from the skill store."""
    path = export_dir(spark, "skills")
    stored = Batch(spark, sf).remap(skills_path=path)["skills"]
    skills = commits.read_keyed(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields))
    rows = skills.select("skill_id", "fingerprint", F.posexplode("steps").alias("n", "s"))
    return rows.select("skill_id", "fingerprint", (F.col("n") + 1).cast("int").alias("step_no"),
                       *[F.col(f"s.{c}").alias(c) for c in ("op", "from", "to", "column", "type", "format")])


@register("d4_run_log", with_ctes(*_BASE, body="""
SELECT 'gate' AS run_id, skill_id, CASE kind WHEN 'exact' THEN 'ok' ELSE 'drift_' || kind END AS status, CAST(1 AS BIGINT) AS n_inputs, kind FROM kinds
UNION ALL
SELECT 'remap', k.skill_id, 'ok', 1, CASE WHEN unmapped.skill_id IS NULL THEN 'exact' ELSE 'mappable' END FROM kinds k
LEFT JOIN (SELECT DISTINCT p.skill_id FROM pair p JOIN sheet_catalog c USING (source_id) WHERE """ + norm("c.name") + """ NOT IN (SELECT norm FROM syn)) unmapped
  USING (skill_id) WHERE k.kind = 'mappable'"""))
def d4_run_log(spark, sf):
    """The gate logged twice under one id (a retry), a write that stopped before its commit,
    and the remap's run: read back, each run is there once."""
    path = export_dir(spark, "runs")
    batch = Batch(spark, sf)
    for _ in range(2):
        gate = batch.gate(runs_path=path, run_id="gate")
    commits._staged(drift.run_rows(gate["drift"]).select(F.lit("lost").alias("run_id"), "skill_id", "status", "n_inputs",
                                                         F.current_timestamp().alias("created_at")), path, "runs", "lost")
    batch.remap(runs_path=path, run_id="remap")
    runs, reports = commits.read_runs(spark, path), commits.read_reports(spark, path)
    return runs.join(reports, ["run_id", "skill_id"]).select("run_id", "skill_id", "status", "n_inputs", "kind")


@register("c12_upsert_memory", with_ctes(*SHEET_BASE, BACKFILLED, MEMORY, ("old_fp", """
SELECT DISTINCT fingerprint FROM sheet_fp WHERE source_order % 2 = 0"""), ("new_fp", """
SELECT DISTINCT fingerprint FROM sheet_fp WHERE source_order % 2 = 1"""), body="""
SELECT m.fingerprint, m.pos, m.source_col, CASE WHEN n.fingerprint IS NULL THEN m."to" ELSE upper(m."to") END AS "to",
       CASE WHEN n.fingerprint IS NULL THEN 0 ELSE 1 END AS generation
FROM mem m LEFT JOIN new_fp n USING (fingerprint)
WHERE m.fingerprint IN (SELECT fingerprint FROM old_fp) OR n.fingerprint IS NOT NULL"""))
def c12_upsert_memory(spark, sf):
    """A memory of the even sheets' shapes, then the mapping of the odd ones (their targets in
    capitals) upserted into it: known shapes are replaced whole, others stay, new ones join."""
    path = export_dir(spark, "memory")
    c = sheet_catalog(spark, sf)
    sources, proposal = materialize(sheet_sources(spark, sf, c)), materialize(sheet_confirmed_proposal(spark, sf, c))
    for g, to in ((0, F.col("to")), (1, F.upper("to"))):
        mine = sources.where(F.col("source_order") % 2 == g)
        rows = mp.confirm_mapping(proposal.withColumn("to", to), c, mine, confirmed_at=CONFIRMED_AT).withColumn("generation", F.lit(g))
        commits.upsert_keyed(path, rows, "fingerprint")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return commits.read_keyed(spark, path, schema).select("fingerprint", "pos", "source_col", "to", "generation")
