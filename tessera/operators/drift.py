"""Schema-drift gate and skill replay.

Drift is decided for every (skill, source) pair in one job: required names
(the ``from`` of every ``map_column`` step) and incoming names are normalized,
de-duplicated (the last spelling of a normalized name wins, its first position
orders it), then matched with a full outer join on
``(skill_id, source_id, norm)``. Per pair the lists are bounded by the schema
width, never by data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import norm_name_py, normalize_name
from tessera.operators.commits import record_runs, upsert_keyed
from tessera.operators.fold import replay_pairs
from tessera.operators.mapping import propose_by_synonyms
from tessera.operators.ops import STEP_SCHEMA, apply_steps
from tessera.operators.sizing import materialize, shuffled
from tessera.operators.unify import replay_union

# Drift kinds, by severity.
EXACT, MAPPABLE, UNMAPPABLE = "exact", "mappable", "unmappable"
SEVERITY = {EXACT: 0, MAPPABLE: 1, UNMAPPABLE: 2}
# Run statuses recorded per kind.
RUN_STATUS = {EXACT: "ok", MAPPABLE: "drift_mappable", UNMAPPABLE: "drift_unmappable"}


def steps_rows(skills: DataFrame) -> DataFrame:
    """``skills(skill_id, steps array<struct>)`` -> one row per step with its index."""
    return skills.select("skill_id", F.posexplode("steps").alias("step_no", "s")).select(
        "skill_id", "step_no", "s.*")


def required_columns(skills: DataFrame) -> DataFrame:
    """``(skill_id, pos, name)``: the ``from`` of every ``map_column`` step."""
    return steps_rows(skills).where(F.col("op") == "map_column").select(
        "skill_id", F.col("step_no").cast("int").alias("pos"), F.col("from").alias("name"))


def _dedupe_norm(df: DataFrame, key: str) -> DataFrame:
    """One row per normalized name: the last spelling, at its first position."""
    return (
        df.withColumn("norm", normalize_name("name"))
        .groupBy(key, "norm")
        .agg(F.max_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    )


def name_arrays(df: DataFrame, key: str, out: str) -> DataFrame:
    """``(key, out array<struct<pos, norm, name>>)`` in column order: a file's
    (or a skill's) de-duplicated names, bounded by its width."""
    d = _dedupe_norm(df, key)
    return d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "norm", "name"))).alias(out))


def _verdict(req: Column, inc: Column) -> list[Column]:
    empty = F.array().cast("array<struct<pos:int,norm:string,name:string>>")
    req = F.coalesce(req, empty)
    inc = F.coalesce(inc, empty)
    inc_norms = F.transform(inc, lambda x: x["norm"])
    req_norms = F.transform(req, lambda x: x["norm"])
    missing = F.transform(F.filter(req, lambda r: ~F.array_contains(inc_norms, r["norm"])), lambda r: r["name"])
    extra = F.transform(F.filter(inc, lambda i: ~F.array_contains(req_norms, i["norm"])), lambda i: i["name"])
    nm, ne = F.size(missing), F.size(extra)
    kind = (
        F.when((nm == 0) & (ne == 0), F.lit(EXACT))
        .when(nm == 0, F.lit(MAPPABLE))
        .when(ne >= nm, F.lit(MAPPABLE))
        .otherwise(F.lit(UNMAPPABLE))
    )
    return [kind.alias("kind"), missing.alias("missing"), F.when(kind != UNMAPPABLE, extra).alias("extra")]


def classify_drift(pairs: DataFrame, required: DataFrame, incoming: DataFrame) -> DataFrame:
    """``pairs(skill_id, source_id)``, ``required(skill_id, pos, name)``,
    ``incoming(source_id, pos, name)`` (a catalog) ->
    ``(skill_id, source_id, kind, missing array, extra array)``.

    Rules: nothing missing and nothing extra -> exact; nothing missing ->
    mappable; at least as many extra as missing -> mappable; else unmappable
    (and only ``missing`` is reported). Each side is reduced to one name array
    per skill / per source first, so the pairs meet them with two equi-joins.
    """
    req = name_arrays(required.select("skill_id", "pos", "name"), "skill_id", "_req")
    inc = name_arrays(incoming.select("source_id", "pos", "name"), "source_id", "_inc")
    j = pairs.join(shuffled(req), ["skill_id"], "left").join(shuffled(inc), ["source_id"], "left")
    return j.select("skill_id", "source_id", *_verdict(F.col("_req"), F.col("_inc")))


def classify_drift_one(required_names: list[str], incoming: DataFrame, skill_id: int = 1,
                       sources: DataFrame | None = None) -> DataFrame:
    """Drift of every source against one skill: the skill's required names are
    a literal array (one aggregate per source). ``sources(source_id)`` names the batch:
    a source without columns is judged too."""
    by_norm: dict[str, list] = {}
    for pos, name in enumerate(required_names):
        n = norm_name_py(name)
        if n in by_norm:
            by_norm[n][1] = name
        else:
            by_norm[n] = [pos, name]
    req = F.array(*[F.struct(F.lit(p).cast("int").alias("pos"), F.lit(n).alias("norm"), F.lit(nm).alias("name"))
                    for n, (p, nm) in by_norm.items()])
    inc = name_arrays(incoming.select("source_id", "pos", "name"), "source_id", "_inc")
    if sources is not None:
        inc = sources.select("source_id").distinct().join(inc, "source_id", "left")
    return inc.select(F.lit(skill_id).cast("long").alias("skill_id"), "source_id", *_verdict(req, F.col("_inc")))


def worst_drift(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Batch verdict: unmappable > mappable > exact, with bucket counts."""
    sev = (F.when(F.col("kind") == UNMAPPABLE, 2).when(F.col("kind") == MAPPABLE, 1).otherwise(0))
    worst = F.max(sev)
    return reports.groupBy(*(by or [])).agg(
        F.when(worst == 2, UNMAPPABLE).when(worst == 1, MAPPABLE).otherwise(EXACT).alias("worst"),
        F.count_if(F.col("kind") == EXACT).alias("n_exact"),
        F.count_if(F.col("kind") == MAPPABLE).alias("n_mappable"),
        F.count_if(F.col("kind") == UNMAPPABLE).alias("n_unmappable"),
    )


def replay(steps: list[dict], sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Plan run per source (one shape per DataFrame), results unioned by name.
    Dedupe stays within each file via ``source_file``."""
    frames = []
    for name, df in sources:
        d = df if "source_file" in df.columns else df.withColumn("source_file", F.lit(name))
        frames.append(apply_steps(d, steps, scope="source_file"))
    return replay_union(frames)


def apply_skill(skill_steps: list[dict], sources: list[tuple[str, DataFrame]], catalog: DataFrame,
                skill_id: int = 1, runs_path: str | None = None, run_at=None, run_id: str | None = None) -> dict:
    """Drift gate, then: exact -> replayed rows; mappable -> a fresh proposal for
    the drifted sources; unmappable -> report only. The worst source decides for the
    batch; sources are the names given or, of frames that have it, their ``source_file``s. The run
    and its reports are logged when ``runs_path`` is given, once for a ``run_id``. The only
    driver decision is the one-row verdict."""
    if not sources:
        raise ValueError("no sources")
    spark = catalog.sparkSession
    batch = replay_union([df.select(F.col("source_file").alias("source_id")).distinct() if "source_file" in df.columns
                          else spark.createDataFrame([(name,)], "source_id string") for name, df in sources])
    required = [s["from"] for s in skill_steps if s["op"] == "map_column"]
    reports = materialize(classify_drift_one(required, catalog, skill_id, batch))
    verdict = worst_drift(reports).first()["worst"]
    out = {"status": RUN_STATUS[verdict], "kind": verdict, "drift": reports}
    if verdict == EXACT:
        out["result"] = replay(skill_steps, sources)
    elif verdict == MAPPABLE:
        out["proposed_mapping"] = propose_remap(catalog)
    if runs_path:
        out["run_id"] = record_runs(runs_path, run_rows(reports), reports, run_id, run_at)
    return out


def run_rows(reports: DataFrame, status: str | None = None) -> DataFrame:
    """``(skill_id, status, n_inputs)``: one log row a skill, by its worst report."""
    worst = worst_drift(reports, ["skill_id"])
    n = F.col("n_exact") + F.col("n_mappable") + F.col("n_unmappable")
    known = F.create_map(*[F.lit(x) for item in RUN_STATUS.items() for x in item])
    return worst.select("skill_id", (F.lit(status) if status else F.element_at(known, F.col("worst"))).alias("status"), n.alias("n_inputs"))


def incoming_names(headers: DataFrame) -> DataFrame:
    """``(source_id, pos, name)`` from ``headers(source_file, header)``."""
    return headers.select(F.col("source_file").alias("source_id"), F.posexplode("header").alias("pos", "name"))


def apply_skills(skills: DataFrame, grid: DataFrame, headers: DataFrame, pairs: DataFrame, runs_path: str | None = None,
                 run_at=None, run_id: str | None = None) -> dict:
    """The drift gate for many skills in one job: each skill of ``skills(skill_id, steps)`` is
    put to its sources ``pairs(skill_id, source_file)``. Skills whose sources are all exact
    are replayed (``result``, rows as in ``fold.replay_pairs``, and ``problems``); drifted
    but mappable ones get a fresh alignment of their sources' columns (``proposed_mapping``
    by skill); the others only reports. ``verdicts`` has a row a skill."""
    wanted = pairs.select("skill_id", F.col("source_file").alias("source_id")).distinct()
    names = incoming_names(headers)
    reports = materialize(classify_drift(wanted, required_columns(skills), names))
    verdicts = materialize(worst_drift(reports, ["skill_id"]))
    exact = pairs.join(shuffled(verdicts.where(F.col("worst") == EXACT)), "skill_id", "left_semi")
    drifted = wanted.join(shuffled(verdicts.where(F.col("worst") == MAPPABLE)), "skill_id", "left_semi").join(shuffled(names), "source_id")
    asked = drifted.select("skill_id", F.col("name").alias("source_col")).distinct()
    aligned = asked.join(propose_by_synonyms(drifted.select("name")), "source_col")
    rows, problems = replay_pairs(skills, grid, headers, exact)
    out = {"verdicts": verdicts, "drift": reports, "result": rows, "problems": problems,
           "proposed_mapping": aligned.select("skill_id", "source_col", "to", "confidence", "rationale")}
    if runs_path:
        out["run_id"] = record_runs(runs_path, run_rows(reports), reports, run_id, run_at)
    return out


def propose_remap(catalog: DataFrame) -> DataFrame:
    """Fresh column alignment for drifted sources."""
    return propose_by_synonyms(catalog)


def remap_steps(steps: list[dict], mapping) -> list[dict]:
    """The plan with its renames taken from ``mapping`` (column to target, or to an entry
    that holds it, in order) and all its other steps as they were."""
    entries = dict(mapping)
    targets = {column: entry.get("to") if isinstance(entry, dict) else entry for column, entry in entries.items()}
    renames = [{"op": "map_column", "from": column, "to": target} for column, target in targets.items() if target]
    return [*renames, *(step for step in steps if step["op"] != "map_column")]


def remap_skill(steps: list[dict], mapping: DataFrame, sources: list[tuple[str, DataFrame]], catalog: DataFrame,
                memory: DataFrame | None = None, confirmed_at=None, skill_id: int = 1, runs_path: str | None = None,
                run_id: str | None = None) -> dict:
    """Close the drift loop for one skill: the confirmed ``mapping``
    (``source_col, to, confidence, rationale``) replaces the renames, the
    skill is re-fingerprinted from the first new source, the mapping is stored
    for every new source's fingerprint, and the new plan is replayed.

    ``catalog`` holds the new sources' columns (``source_id`` = source name). With
    ``runs_path`` the run is logged as ok, with the new plan's reports.
    Only the mapping entries (a column-name list, small) reach the driver, in the order
    in which the sources hold their columns.
    """
    from tessera.operators.catalog import fingerprints
    from tessera.operators.mapping import confirm_mapping

    names = [n for n, _ in sources]
    fps = fingerprints(catalog)
    order = {n: i for i, n in enumerate(names)}
    order_df = catalog.sparkSession.createDataFrame(list(order.items()), "source_id string, source_order int")
    seen = catalog.select("source_id", "pos", "name").join(order_df, "source_id").groupBy(F.col("name").alias("source_col")).agg(F.min(F.struct("source_order", "pos")).alias("_at"))
    renames = mapping.where(F.col("to").isNotNull()).join(seen, "source_col", "left").orderBy(F.col("_at").asc_nulls_last(), "source_col")
    new_steps = remap_steps(steps, [(r["source_col"], r["to"]) for r in renames.select("source_col", "to").collect()])
    srcs = fps.join(order_df, "source_id")
    first_fp = srcs.where(F.col("source_order") == 0).select("fingerprint").first()
    new_memory = confirm_mapping(mapping, catalog, srcs, memory, confirmed_at)
    if runs_path:
        reports = classify_drift_one([s["from"] for s in new_steps if s["op"] == "map_column"], catalog, skill_id, order_df)
        record_runs(runs_path, run_rows(reports, RUN_STATUS[EXACT]), reports, run_id)
    return {"steps": new_steps, "fingerprint": first_fp["fingerprint"] if first_fp else None,
            "memory": new_memory, "result": replay(new_steps, sources)}


def remap_skills_table(skills: DataFrame, new_maps: DataFrame) -> DataFrame:
    """Rewrite the step arrays of every affected skill in one job.

    ``new_maps(skill_id, steps)`` holds the replacement ``map_column`` steps.
    """
    kept = F.filter(F.col("steps"), lambda s: s["op"] != "map_column")
    j = skills.join(shuffled(new_maps.select("skill_id", F.col("steps").alias("_new"))), "skill_id", "left")
    return j.select(*[c for c in skills.columns if c != "steps"],
                    F.when(F.col("_new").isNotNull(), F.concat("_new", kept)).otherwise(F.col("steps")).alias("steps"))


def remap_skills(skills: DataFrame, mapping: DataFrame, grid: DataFrame, headers: DataFrame, pairs: DataFrame,
                 memory_path: str | None = None, skills_path: str | None = None, runs_path: str | None = None,
                 confirmed_at=None, run_id: str | None = None) -> dict:
    """Closes the drift loop for many skills in one job.

    ``skills(skill_id, steps, ...)``; ``mapping(source_col, to, confidence, rationale)`` is the
    confirmed alignment of the batch; ``pairs(skill_id, source_file, source_order)`` gives
    each skill its new sources. Every skill of ``pairs`` gets renames for the columns of its
    sources (in the order in which the sources hold them), keeps its other steps, and
    takes the fingerprint of its first new source. All sources are replayed. With paths,
    the mapping of each new fingerprint is upserted in the memory store, the rewritten
    skills in the skill store, and the run is logged as ok.
    """
    from tessera.operators.catalog import VARCHAR, fingerprints
    from tessera.operators.mapping import confirm_mapping

    names = incoming_names(headers)
    of_source = pairs.select("skill_id", F.col("source_file").alias("source_id"), "source_order")
    held = of_source.join(shuffled(names), "source_id").groupBy("skill_id", F.col("name").alias("source_col")).agg(F.min(F.struct("source_order", "pos")).alias("at"))
    wanted = held.join(mapping.where(F.col("to").isNotNull() & (F.col("to") != "")), "source_col")
    rename = F.struct(F.lit("map_column").alias("op"), F.col("source_col").alias("from"), F.col("to"),
                      *[F.lit(None).cast(t).alias(n) for n, t in (("column", "string"), ("type", "string"), ("format", "string"),
                                                                  ("keys", "array<string>"), ("predicate", "string"), ("expr", "string"))])
    ordered = F.array_sort(F.collect_list(F.struct("at", "source_col", rename.alias("step"))))  # a skill's columns
    renames = of_source.select("skill_id").distinct().join(
        shuffled(wanted.groupBy("skill_id").agg(F.transform(ordered, lambda x: x["step"]).alias("steps"))), "skill_id", "left")
    renames = renames.withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{STEP_SCHEMA}>")))
    catalog = names.withColumn("type", F.lit(VARCHAR))
    sources = materialize(shuffled(fingerprints(catalog)).join(of_source.groupBy("source_id").agg(F.max("source_order").alias("source_order")), "source_id"))
    first = of_source.join(shuffled(sources.select("source_id", "fingerprint")), "source_id").groupBy("skill_id").agg(
        F.min_by("fingerprint", F.struct("source_order", "source_id")).alias("_first"))
    rewritten = remap_skills_table(skills, renames).join(shuffled(first), "skill_id", "left")
    old = F.col("fingerprint") if "fingerprint" in skills.columns else F.lit(None).cast("string")
    rewritten = materialize(rewritten.withColumn("fingerprint", F.coalesce("_first", old)).drop("_first"))
    changed = rewritten.join(shuffled(of_source.select("skill_id").distinct()), "skill_id", "left_semi")
    memory = materialize(confirm_mapping(mapping, catalog, sources, None, confirmed_at))
    rows, problems = replay_pairs(changed, grid, headers, pairs)
    out = {"skills": rewritten, "memory": memory, "result": rows, "problems": problems}
    if memory_path:
        upsert_keyed(memory_path, memory, "fingerprint")
    if skills_path:
        upsert_keyed(skills_path, changed, "skill_id")
    if runs_path:
        reports = materialize(classify_drift(of_source.select("skill_id", "source_id").distinct(), required_columns(changed), names))
        out["run_id"] = record_runs(runs_path, run_rows(reports, RUN_STATUS[EXACT]), reports, run_id)
    return out


def snapshot(steps: list[dict], sources: list[tuple[str, DataFrame]], limit: int | None = None,
             order_by: list | None = None) -> DataFrame:
    """Plan run per source, unioned, with ``limit`` at most so many rows, every value as text
    (NULL kept). ``order_by`` makes the chosen rows deterministic."""
    df = replay(steps, sources)
    if order_by:
        df = df.orderBy(*order_by)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
