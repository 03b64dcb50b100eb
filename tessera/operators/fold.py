"""Plans as data: many skills replayed in one job (D4, D6 over tables).

``ops.apply_steps`` builds a plan for one skill and one shape. Here skills are rows, and
each skill's step array is folded with higher-order functions in two stages:

* over the *header* of each (skill, source) pair, one row a pair: renames become cell
  places and names, steps become a program of column places, and a step whose column is
  not there becomes the pair's ``problem``;
* over the *cells* of each data row: the program runs as one fold over an array of values.

So the plan does not grow with the number of skills, sources or shapes. Values are text in
the form that their type prints, next to an array of their types; this is exact both ways
for the types that steps can give. What cannot be data is the text of ``derive`` and
``filter`` expressions: each distinct text (with the types of the names it reads) is one
branch of the plan. Steps run in rounds that end at a ``derive`` or a ``dedupe``, and there
are as many rounds as the longest chain of these in one skill.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.casts import safe_cast, try_date
from tessera.functions.datefmt import try_strptime
from tessera.functions.names import unique_names
from tessera.functions.text import normalize_name, normalize_phone
from tessera.operators.ops import EXPRESSIONS, REFUSED, VOCABULARY
from tessera.operators.sizing import materialize, shuffled

TYPES = ("DECIMAL", "DOUBLE", "INTEGER", "BIGINT", "DATE", "VARCHAR")
SPARK_TYPES = {"DECIMAL": "decimal(18,3)", "DOUBLE": "double", "INTEGER": "int", "BIGINT": "bigint", "DATE": "date", "VARCHAR": "string"}
VALUE_OPS = ("cast", "parse_date", "normalize_phone", "derive")

#: One step of a program: ``at`` and ``to`` are places (from 0) in the pair's values.
_ACTION = "struct<round:int,op:string,at:int,to:int,seen:int,type:string,format:string,expr:string,keys:array<int>>"
_COMPILED = f"struct<names:array<string>,round:int,actions:array<{_ACTION}>,problem:string>"


def _place(names: Column, name: Column) -> Column:
    """Place of ``name``: the exact name, else the only one equal after normalization; else null."""
    exact = F.array_position(names, name).cast("int")
    alike = F.filter(F.transform(names, lambda n, i: F.when(normalize_name(n) == normalize_name(name), i)), lambda i: i.isNotNull())
    return F.when(exact > 0, exact - 1).when(F.size(alike) == 1, F.get(alike, F.lit(0)))


def _step_problem(step: Column) -> Column:
    """SQL form of ``ops.step_problem`` for a step struct."""
    found = F.when(~F.coalesce(step["op"].isin(list(VOCABULARY)), F.lit(False)), F.concat(F.lit("unknown op: "), F.coalesce(step["op"], F.lit("null"))))
    for op, keys in VOCABULARY.items():
        for key in keys:
            empty = (F.coalesce(F.size(step[key]), F.lit(0)) <= 0) if key == "keys" else (F.coalesce(step[key], F.lit("")) == "")
            found = found.when((step["op"] == op) & empty, F.lit(f"{op} needs {key}"))
    for op, key in EXPRESSIONS.items():
        found = found.when((step["op"] == op) & step[key].rlike(REFUSED), F.concat(F.lit("unsafe expression: "), step[key]))
    return found.when((step["op"] == "cast") & ~F.upper(step["type"]).isin(list(TYPES)), F.concat(F.lit("unsupported cast type: "), step["type"]))


def _rename(header: Column, steps: Column) -> tuple[Column, Column, Column]:
    """Cell places and names after all renames, and the first rename without its column.
    Renamed columns come first in step order, a column renamed twice at its first place
    under its last name; the others follow unchanged."""
    maps = F.filter(steps, lambda s: s["op"] == "map_column")
    asked = F.transform(maps, lambda s: F.struct(_place(header, s["from"]).alias("at"), s["to"].alias("to"), s["from"].alias("from")))
    lost = F.get(F.filter(asked, lambda r: r["at"].isNull()), F.lit(0))["from"]
    places = F.array_distinct(F.filter(F.transform(asked, lambda r: r["at"]), lambda p: p.isNotNull()))
    targets = F.transform(places, lambda p: F.try_element_at(F.filter(asked, lambda r: r["at"] == p), F.lit(-1))["to"])
    rest = F.filter(F.transform(header, lambda _, i: i), lambda i: ~F.array_contains(places, i))
    names = F.concat(targets, F.transform(rest, lambda i: F.get(header, i)))
    return F.concat(places, rest), unique_names(names), F.when(lost.isNotNull(), F.concat(F.lit("column not found: "), lost))


def _compile(state: Column, step: Column) -> Column:
    """One value step or row step added to the program."""
    names, op = state["names"], step["op"]
    at = F.when(op.isin("cast", "parse_date", "normalize_phone"), _place(names, step["column"]))
    known = F.array_position(F.transform(names, F.lower), F.lower(step["to"])).cast("int") - 1
    to = (F.when(op == "derive", F.when(known >= 0, known).otherwise(F.size(names)))
          .when(op == "parse_date", _place(names, F.coalesce(F.nullif(step["to"], F.lit("")), step["column"])))
          .when(op.isin("cast", "normalize_phone"), at))
    keys = F.when(op == "dedupe", F.transform(step["keys"], lambda k: _place(names, k)))
    lost = ((op.isin("cast", "parse_date", "normalize_phone") & (at.isNull() | to.isNull()))
            | F.coalesce(F.exists(keys, lambda k: k.isNull()), F.lit(False)))
    kind = F.when(op == "cast", F.coalesce(F.upper(step["type"]), F.lit("VARCHAR"))).when(op == "parse_date", F.lit("DATE")).otherwise(F.lit("VARCHAR"))
    new = (op == "derive") & (to == F.size(names))
    action = F.struct(
        state["round"].alias("round"), op.alias("op"), at.alias("at"), to.alias("to"), F.size(names).alias("seen"), kind.alias("type"),
        F.coalesce(F.nullif(step["format"], F.lit("")), F.lit("auto")).alias("format"),
        F.coalesce(step["expr"], step["predicate"]).alias("expr"), keys.alias("keys")).cast(_ACTION)
    where = F.concat(op, F.lit(": column not found: "), F.coalesce(step["column"], F.array_join(step["keys"], ", "), F.lit("")))
    return F.struct(
        F.when(new, F.concat(names, F.array(step["to"]))).otherwise(names).alias("names"),
        (state["round"] + F.when(op.isin("derive", "dedupe"), 1).otherwise(0)).alias("round"),
        F.concat(state["actions"], F.array(action)).alias("actions"),
        F.coalesce(state["problem"], F.when(lost, where)).alias("problem")).cast(_COMPILED)


def compile_pairs(skills: DataFrame, headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """One program for each pair: ``(skill_id, source_file, take, names, value, row, problem)``.
    ``skills(skill_id, steps)``, ``headers(source_file, header)`` with names unique,
    ``pairs(skill_id, source_file)``. ``take`` holds the cell places of the first names,
    ``value`` and ``row`` the actions of the second and third phase."""
    joined = pairs.select("skill_id", "source_file").distinct().join(shuffled(skills.select("skill_id", "steps")), "skill_id")
    joined = joined.join(shuffled(headers.select("source_file", "header")), "source_file")
    take, names, lost = _rename(F.col("header"), F.col("steps"))
    bad = F.get(F.filter(F.transform("steps", _step_problem), lambda p: p.isNotNull()), F.lit(0))
    begun = joined.select("*", take.alias("take"), names.alias("_names"), F.coalesce(bad, lost).alias("_lost"))

    def phase(ops: tuple[str, ...], names: str, problem: str) -> Column:
        start = F.struct(F.col(names).alias("names"), F.lit(0).alias("round"), F.array().cast(f"array<{_ACTION}>").alias("actions"),
                         F.col(problem).alias("problem")).cast(_COMPILED)
        return F.aggregate(F.filter("steps", lambda s: s["op"].isin(*ops)), start, _compile)

    done = begun.withColumn("_v", phase(VALUE_OPS, "_names", "_lost")).withColumn("_r", phase(("filter", "dedupe"), "_v.names", "_v.problem"))
    return done.select("skill_id", "source_file", "take", "_v.names", F.col("_v.actions").alias("value"), F.col("_r.actions").alias("row"), "_r.problem")


def _converted(value: Column, action: Column, formats: list[str]) -> Column:
    """``value`` after a cast, parse_date or normalize_phone, as the text of its type."""
    out = F.when(action["op"] == "normalize_phone", normalize_phone(value))
    for kind in TYPES[:-1]:
        out = out.when((action["op"] == "cast") & (action["type"] == kind), safe_cast(value, kind).cast("string"))
    for text in formats:
        out = out.when((action["op"] == "parse_date") & (action["format"] == text), F.to_date(try_strptime(value, text)).cast("string"))
    return out.when(action["op"] == "parse_date", try_date(value).cast("string")).otherwise(value)


@dataclass(frozen=True)
class Expression:
    """A distinct expression text with the names it reads, their types, and its own type."""

    text: str
    reads: tuple[tuple[str, str], ...]
    type: str


def _reads(action: Column) -> Column:
    """Names (with types) that may stand in an action's expression: whole words of it, or
    quoted by backticks, among the names that exist by then."""
    low = F.lower(action["expr"])
    words = F.concat(F.regexp_extract_all(low, F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0)), F.regexp_extract_all(low, F.lit("`([^`]+)`"), F.lit(1)))
    known = F.slice(F.arrays_zip("names", "types"), F.lit(1), action["seen"])
    return F.filter(known, lambda c: F.array_contains(words, F.lower(c["names"])))


def _bind(programs: DataFrame, actions: Column, out: str) -> tuple[DataFrame, list[Expression]]:
    """``programs`` with ``out``, the numbers of the distinct expressions that ``actions``
    (an array) hold, null where an action has none; and these expressions, typed by
    Spark's own analysis. What cannot be analysed is its programs' problem. One row for each
    distinct text and types of what it reads reaches the driver: the branches of the plan."""
    spark = programs.sparkSession
    key = lambda a: F.when(a["expr"].isNotNull(), F.to_json(F.struct(a["expr"].alias("expr"), _reads(a).alias("reads"))))
    keyed = programs.withColumn("_acts", actions).withColumn("_keys", F.transform("_acts", key))
    use = keyed.where("problem is null").select(F.explode("_keys").alias("key")).where("key is not null").distinct().collect()
    found: list[Expression] = []
    number, wrong = {}, {}
    for r in sorted(use):
        at = json.loads(r["key"])
        reads = tuple((c["names"], c["types"]) for c in at["reads"])
        schema = T.StructType([T.StructField(n, T.DataType.fromDDL(SPARK_TYPES.get(t, t))) for n, t in reads])
        try:
            kind = spark.createDataFrame([], schema).select(F.expr(at["expr"]).alias("e")).schema["e"].dataType.simpleString()
        except (AnalysisException, ParseException) as e:
            wrong[r["key"]] = f"{at['expr']}: {e.getCondition() or 'not valid'}"
            continue
        number[r["key"]] = len(found)
        found.append(Expression(at["expr"], reads, kind))

    def looked_up(values: dict, kind: str) -> Column:
        if not values:
            return F.transform("_keys", lambda k: F.lit(None).cast(kind))
        table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
        return F.transform("_keys", lambda k: F.when(k.isNotNull(), F.try_element_at(table, k)))

    problem = F.get(F.filter(looked_up(wrong, "string"), lambda p: p.isNotNull()), F.lit(0))
    bound = keyed.withColumn(out, looked_up(number, "int")).withColumn("problem", F.coalesce("problem", problem))
    return bound.drop("_acts", "_keys"), found


def _rounds(programs: DataFrame, column: str) -> int:
    last = programs.agg(F.max(F.array_max(F.transform(column, lambda a: a["round"])))).first()[0]
    return 0 if last is None else last + 1


def bind(programs: DataFrame) -> tuple[DataFrame, list[list[Expression]], list[Expression]]:
    """Types of all values and numbers of all expressions: ``types``, ``derives`` (one number
    a round, null without) and ``filters`` (one a row action); the derive expressions of
    each round, and the filter expressions."""
    programs = programs.withColumn("types", F.transform("names", lambda n: F.when(n.isNotNull(), "VARCHAR"))).withColumn("derives", F.array().cast("array<int>"))
    by_round: list[list[Expression]] = []
    for round_ in range(_rounds(programs, "value")):
        plain = F.filter("value", lambda a: (a["round"] == round_) & (a["op"] != "derive"))
        kinds = F.aggregate(plain, F.col("types"), lambda types, a: F.transform(types, lambda t, i: F.when(i == a["to"], a["type"]).otherwise(t)))
        programs = programs.withColumn("types", kinds)
        mine = F.filter("value", lambda a: (a["round"] == round_) & (a["op"] == "derive"))
        programs, found = _bind(programs, mine, "_now")
        now = F.get("_now", F.lit(0))
        programs = programs.withColumn("derives", F.concat("derives", F.array(now)))
        if found:
            kind = F.get(F.array(*[F.lit(e.type) for e in found]), now)
            to = F.get(mine, F.lit(0))["to"]
            programs = programs.withColumn("types", F.transform("types", lambda t, i: F.when((i == to) & now.isNotNull(), kind).otherwise(t)))
        programs = materialize(programs.drop("_now"))
        by_round.append(found)
    programs, filters = _bind(programs, F.col("row"), "filters")
    return materialize(programs), by_round, filters


def _with_expression(rows: DataFrame, expression: Expression, here: Column, out: str) -> DataFrame:
    """``rows`` with the expression's value as text in column ``out``, where ``here``."""
    reads = [F.get("values", F.array_position("names", F.lit(n)).cast("int") - 1).cast(SPARK_TYPES.get(t, t)) for n, t in expression.reads]
    scope = rows.select(F.struct(*rows.columns).alias("_all"), here.alias("_here"),
                        *[F.when(here, c).alias(n) for c, (n, _) in zip(reads, expression.reads)])
    value = F.when(F.col("_here"), F.expr(expression.text)).cast("string")
    return scope.select("_all", value.alias(out)).select("_all.*", out)


def _run_values(rows: DataFrame, by_round: list[list[Expression]], formats: list[str]) -> DataFrame:
    def step(values: Column, a: Column) -> Column:
        new = _converted(F.get(values, a["at"]), a, formats)
        return F.transform(values, lambda v, i: F.when(i == a["to"], new).otherwise(v))

    for round_, derives in enumerate(by_round):
        mine = F.filter("value", lambda a: (a["round"] == round_) & (a["op"] != "derive"))
        rows = rows.withColumn("values", F.aggregate(mine, F.col("values"), step))
        for k, e in enumerate(derives):
            here = F.coalesce(F.get("derives", F.lit(round_)) == k, F.lit(False))
            to = F.get(F.filter("value", lambda a: (a["round"] == round_) & (a["op"] == "derive")), F.lit(0))["to"]
            found = _with_expression(rows, e, here, "_new")
            put = F.transform("values", lambda v, i: F.when(i == to, F.col("_new")).otherwise(v))
            rows = found.withColumn("values", F.when(here, put).otherwise(F.col("values"))).drop("_new")
    return rows


def _sort_key(values: Column, types: Column) -> Column:
    """What orders values of one column: numbers and dates by value, text by code points."""
    def key(v: Column, t: Column) -> Column:
        whole = F.when(t.isin("INTEGER", "BIGINT", "DECIMAL") | t.startswith("decimal") | t.isin("int", "bigint"), v.cast("decimal(38,9)"))
        return F.struct(whole.alias("whole"), F.when(F.lower(t) == "double", v.cast("double")).alias("float"),
                        F.when(whole.isNull() & (F.lower(t) != "double"), v).alias("text"))
    return F.zip_with(values, types, key)


def _where(rows: DataFrame, keep: Column) -> DataFrame:
    """Rows where ``keep``. Its inputs are the folds before it: as a filter it would be
    pushed below them, which writes each fold out once more for every use in ``keep``.
    Nothing is pushed below a generator."""
    row = F.when(keep, F.struct(*rows.columns))
    return rows.select(F.explode_outer(F.array(row)).alias("_row")).where("_row is not null").select("_row.*")


def _run_rows(rows: DataFrame, rounds: int, deduped: int, filters: list[Expression]) -> DataFrame:
    columns = rows.columns
    for round_ in range(rounds):
        for k, e in enumerate(filters):
            here = F.exists(F.arrays_zip("row", "filters"), lambda z: (z["row"]["round"] == round_) & F.coalesce(z["filters"] == k, F.lit(False)))
            rows = _with_expression(rows, e, here, "_kept")
            rows = rows.withColumn(f"_k{k}", ~here | F.coalesce(F.col("_kept") == "true", F.lit(False))).drop("_kept")
        if filters:
            rows = _where(rows, reduce(Column.__and__, [F.col(f"_k{k}") for k in range(len(filters))])).select(*columns)
        if round_ >= deduped:
            continue
        keys = F.get(F.filter("row", lambda a: (a["round"] == round_) & (a["op"] == "dedupe")), F.lit(0))["keys"]
        keyed = rows.withColumn("_places", keys).withColumn("_at", F.when(F.col("_places").isNull(), F.col("row_no")))
        keyed = keyed.withColumn("_key", F.transform("_places", lambda k: F.get("values", k)))
        rest = F.filter(F.transform("values", lambda v, i: i), lambda i: ~F.array_contains("_places", i))
        order = F.transform(rest, lambda i: F.get(_sort_key(F.col("values"), F.col("types")), i))
        row = F.struct(*[c for c in columns if c not in ("skill_id", "source_file")])
        first = keyed.withColumn("_order", order).groupBy("skill_id", "source_file", "_key", "_at").agg(F.min_by(row, F.struct("_order", "row_no")).alias("r"))
        rows = first.select("skill_id", "source_file", "r.*").select(*columns)
    return rows


def replay_pairs(skills: DataFrame, grid: DataFrame, headers: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every pair's skill replayed on its source, all in one job.

    ``grid(source_file, row_no, cells)`` holds data rows; ``row_no`` is unique in its file.
    Returns rows ``(skill_id, source_file, row_no, names, types, values)`` and problems
    ``(skill_id, source_file, problem)`` of pairs that cannot be run (a step whose column
    the source lacks, an expression that Spark refuses); these have no rows, and do not
    keep the others from theirs. Dedupe stays within a skill and source. Equal to
    ``ops.apply_steps`` pair by pair, every value as text.
    """
    programs, derives, filters = bind(materialize(compile_pairs(skills, headers, pairs)))
    good = programs.where("problem is null")
    formats = [r[0] for r in good.select(F.explode("value").alias("a")).where("a.op = 'parse_date' and a.format <> 'auto'")
               .select("a.format").distinct().collect()]  # one branch a distinct format
    deduped = _rounds(good.withColumn("row", F.filter("row", lambda a: a["op"] == "dedupe")), "row")
    cells = F.transform("names", lambda _, i: F.get(F.col("cells"), F.get(F.col("take"), i)))  # derived names have no cell
    rows = grid.select("source_file", "row_no", "cells").join(shuffled(good.drop("problem")), "source_file").withColumn("values", cells).drop("cells", "take")
    rows = _run_rows(_run_values(rows, derives, formats), _rounds(good, "row"), deduped, filters)
    return (rows.select("skill_id", "source_file", "row_no", "names", "types", "values"),
            programs.where("problem is not null").select("skill_id", "source_file", "problem"))


def wide(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Replayed rows as columns: ``fields`` maps names to types (as in ``cast``); a field
    that a row's skill does not produce is NULL."""
    at = {f: F.get("values", F.array_position("names", F.lit(f)).cast("int") - 1) for f in fields}
    return rows.select("skill_id", "source_file", *[at[f].try_cast(SPARK_TYPES.get(t, t)).alias(f) for f, t in fields.items()])
