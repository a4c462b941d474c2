"""Lowering of plan nodes to DataFrames. Pure: nothing here runs a job, except where components are sought.

Every frame carries ``__occ``, an array of longs that orders rows by arrival and tells equal rows apart: a
log row has its position, ``explode`` appends an ordinal, a join concatenates both sides', a group keeps its
smallest. Catalyst drops it wherever no order is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.expressions import Expr
from tidemark.plans.expressions import lower as lower_expr
from tidemark.plans.relation import Aggregate, Node

OCC = "__occ"
LAST = (1 << 63) - 1


def c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Context:
    """What a plan is lowered against: bound frames by node fingerprint, a model, and the hidden window key."""

    spark: SparkSession
    bound: dict[str, DataFrame]
    model: object | None = None
    keys: tuple[str, ...] = ()
    windows: DataFrame | None = None
    options: dict = field(default_factory=dict)
    made: dict[str, DataFrame] = field(default_factory=dict)


LOWER: dict[str, Callable[[Node, Context, list[DataFrame]], DataFrame]] = {}


def lowers(op: str):
    def put(f):
        LOWER[op] = f
        return f

    return put


def lower(node: Node, ctx: Context) -> DataFrame:
    """The frame of ``node``: its columns in order, the hidden keys and ``__occ``."""
    if node.fingerprint in ctx.bound:
        return ctx.bound[node.fingerprint]
    if node.fingerprint not in ctx.made:
        inputs = [lower(n, ctx) for n in node.inputs]
        out = LOWER[node.op](node, ctx, inputs)
        ctx.made[node.fingerprint] = out.select(*map(c, node.columns), *map(c, ctx.keys), c(OCC))
    return ctx.made[node.fingerprint]


def apply_op(node: Node, ctx: Context, inputs: list[DataFrame]) -> DataFrame:
    """``node``'s operator over given inputs."""
    return LOWER[node.op](node, ctx, inputs).select(*map(c, node.columns), *map(c, ctx.keys), c(OCC))


def resolver(df: DataFrame, qualified: dict[str, DataFrame] | None = None, alias: dict[str, str] | None = None):
    """Finds ``name:qualifier`` first, then ``name``."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def find(name: str, qualifier: str | None):
        for n in (f"{name}:{qualifier}", name) if qualifier else (name,):
            if n in types:
                return c(n), types[n]
        raise ValueError(f"no column {name}")

    return find


def value(e: Expr, df: DataFrame) -> Column:
    return lower_expr(e, resolver(df))[0]


@lowers("log")
def _log(node, ctx, inputs):
    raise ValueError("the log is not bound")


@lowers("window_source")
def _window_source(node, ctx, inputs):
    raise ValueError("a window's rows are not bound")


@lowers("select")
def _select(node, ctx, inputs):
    return inputs[0]


@lowers("filter")
def _filter(node, ctx, inputs):
    condition, kind = lower_expr(node.params["predicate"], resolver(inputs[0]))
    if not isinstance(kind, T.BooleanType):
        raise TypeError("the predicate is not boolean")
    return inputs[0].filter(F.coalesce(condition, F.lit(False)))


@lowers("assign")
def _assign(node, ctx, inputs):
    df = inputs[0]
    for name, e in node.params["values"]:  # each sees those before it
        df = df.withColumn(name, value(e, df))
    return df


def _keyed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Null keys are an error."""
    for k in keys:
        df = df.withColumn(k, F.coalesce(c(k), F.raise_error(F.lit(f"null in join key {k}")).cast(df.schema[k].dataType)))
    return df


@lowers("join")
def _join(node, ctx, inputs):
    on, how, sides = node.params["on"], node.params["how"], node.params["sides"]
    left, right = _keyed(inputs[0], on), _keyed(inputs[1], on)
    keys = [*on, *ctx.keys]
    if how == "left_anti":
        return left.join(right.select(*map(c, keys)), keys, "left_anti")
    clash = (set(left.columns) & set(right.columns)) - set(keys) - {OCC}
    left = left.withColumnsRenamed({x: f"{x}:{sides[0]}" for x in clash}).withColumnRenamed(OCC, "__l")
    right = right.withColumnsRenamed({x: f"{x}:{sides[1]}" for x in clash}).withColumnRenamed(OCC, "__r")
    out = left.join(right, keys, {"outer": "full"}.get(how, how))
    none = F.array().cast("array<bigint>")
    return out.withColumn(OCC, F.concat(F.coalesce("__l", F.array(F.lit(LAST))), F.coalesce("__r", none)))


def pair_condition(conditions: tuple, left: dict[str, tuple], right: dict[str, tuple], sides: tuple[str, str]) -> Column:
    """Conjunction over both sides' columns; equalities stay bare, so that they become join keys."""

    def find(name: str, qualifier: str | None):
        if qualifier == sides[0] or (qualifier is None and name in left and name not in right):
            return left[name]
        if qualifier == sides[1] or (qualifier is None and name in right and name not in left):
            return right[name]
        raise ValueError(f"column {name} is not of one side")

    parts = []
    todo = list(conditions)
    while todo:
        e = todo.pop(0)
        if e.op == "and":
            todo = [*e.args, *todo]
        else:
            parts.append(lower_expr(e, find, bare_equality=True)[0])
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def suffixed(df: DataFrame, keep: tuple[str, ...], side: str, occ: str) -> DataFrame:
    return df.select(*(c(x).alias(f"{x}:{side}") for x in keep), c(OCC).alias(occ), *(c(k).alias(f"{k}{occ}") for k in df.columns if k.startswith("__") and k != OCC))


def pairs_of(node: Node, ctx: Context, inputs: list[DataFrame], conditions: tuple) -> DataFrame:
    sides = node.params["sides"]
    left, right = (suffixed(df, n.columns, s, o) for df, n, s, o in zip(inputs, node.inputs, sides, ("__l", "__r"), strict=True))
    kinds = [{n: (left_or[f"{n}:{s}"], left_or.schema[f"{n}:{s}"].dataType) for n in x.columns} for left_or, x, s in zip((left, right), node.inputs, sides, strict=True)]
    condition = pair_condition(conditions, *kinds, sides)
    for k in ctx.keys:
        condition = condition & (left[f"{k}__l"] == right[f"{k}__r"])
    out = left.join(right, condition, "inner").withColumn(OCC, F.concat("__l", "__r"))
    return out.withColumnsRenamed({f"{k}__l": k for k in ctx.keys})


@lowers("predicate_join")
def _predicate_join(node, ctx, inputs):
    return pairs_of(node, ctx, inputs, node.params["on"])


def _numeric(df: DataFrame, name: str) -> Column:
    if not isinstance(df.schema[name].dataType, T.NumericType):
        raise TypeError(f"{name} is not numeric")
    return c(name)


def listed(value: Column) -> Column:
    """Values in order of arrival, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(c(OCC).alias("o"), value.alias("v")))), lambda x: x["v"])


def aggregate_column(df: DataFrame, spec: Aggregate) -> Column:
    if spec.kind == "count":
        return F.count(F.lit(1))
    if spec.kind in ("sum", "avg"):
        return (F.sum if spec.kind == "sum" else F.avg)(_numeric(df, spec.columns[0]))
    if spec.kind == "array_agg":
        return listed(F.struct(*map(c, spec.columns)))
    if spec.kind == "collect_list":
        return listed(c(spec.columns[0]))
    if spec.kind == "min" and not spec.options:
        return F.min(c(spec.columns[0]))
    if spec.kind == "min":
        whole = F.lit(True)
        for x in spec.columns:
            whole = whole & c(x).isNotNull()
        return F.min(F.when(whole, F.struct(*map(c, spec.columns))))
    raise ValueError(f"unknown aggregate {spec.kind}")


def _empty(df: DataFrame, spec: Aggregate, name: str) -> Column:
    if spec.kind == "count":
        return F.coalesce(c(name), F.lit(0).cast("long"))
    if spec.kind in ("array_agg", "collect_list"):
        return F.coalesce(c(name), F.array().cast(df.schema[name].dataType))
    return c(name)


@lowers("aggregate")
def _aggregate(node, ctx, inputs):
    df, keys, specs = inputs[0], node.params["keys"], node.params["specs"]
    if any(s.kind == "sem_agg" for s in specs):
        from tidemark.operators.semantic import semantic_aggregate

        return semantic_aggregate(node, ctx, df)
    outputs = [aggregate_column(df, s).alias(s.output) for s in specs if s.output not in keys]
    grouped = df.groupBy(*map(c, (*ctx.keys, *keys))).agg(*outputs, F.min(OCC).alias(OCC))
    if keys:
        return grouped
    if ctx.keys:  # a window whose rows were all filtered away has a row, too
        grouped = ctx.windows.join(grouped, list(ctx.keys), "left")
    for s in specs:
        grouped = grouped.withColumn(s.output, _empty(grouped, s, s.output))
    return grouped.withColumn(OCC, F.coalesce(OCC, F.array(F.lit(0).cast("long"))))


@lowers("limit")
def _limit(node, ctx, inputs):
    if not ctx.keys:
        return inputs[0].orderBy(OCC).limit(node.params["n"])
    order = Window.partitionBy(*map(c, ctx.keys)).orderBy(OCC)
    return inputs[0].withColumn("__n", F.row_number().over(order)).filter(c("__n") <= node.params["n"])


@lowers("drop_duplicates")
def _drop_duplicates(node, ctx, inputs):
    """First of equal rows by arrival, as an aggregate: copies are combined before the shuffle."""
    df, subset = inputs[0], node.params["subset"] or node.columns
    rest = [x for x in node.columns if x not in subset]
    keys = [*subset, *ctx.keys]
    if not rest:
        return df.groupBy(*map(c, keys)).agg(F.min(OCC).alias(OCC))
    first = F.min_by(F.struct(*map(c, rest)), c(OCC))
    out = df.groupBy(*map(c, keys)).agg(first.alias("__first"), F.min(OCC).alias(OCC))
    return out.select(*map(c, keys), *(c("__first").getField(x).alias(x) for x in rest), OCC)


def _behind(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.withColumn(OCC, F.concat(F.array(F.lit(i).cast("long")), OCC)) for i, df in enumerate((left, right)))


@lowers("concat")
def _concat(node, ctx, inputs):
    left, right = _behind(*inputs)
    return left.unionByName(right)


@lowers("concat_by_name")
def _concat_by_name(node, ctx, inputs):
    left, right = _behind(*inputs)
    return left.unionByName(right, allowMissingColumns=True)


@lowers("subtract")
def _subtract(node, ctx, inputs):
    """Left rows, copies kept, that are not among the right's; nulls are equal."""
    left, right = inputs[0], inputs[1].select(*(c(x).alias(f"__{i}") for i, x in enumerate((*node.columns, *ctx.keys))))
    condition = F.lit(True)
    for i, x in enumerate((*node.columns, *ctx.keys)):
        condition = condition & left[f"`{x}`"].eqNullSafe(right[f"__{i}"])
    return left.join(right, condition, "left_anti")


@lowers("array_cat")
def _array_cat(node, ctx, inputs):
    """Two states of at most one row each."""
    name = node.params["column"]
    parts = []
    for i, df in enumerate(inputs):
        one = df.groupBy(*map(c, ctx.keys)).agg(F.collect_list(c(name)).alias("__x"))
        few = F.when(F.size("__x") > 1, F.raise_error(F.lit("array_cat takes states of one row")).cast(one.schema["__x"].dataType)).otherwise(c("__x"))
        parts.append(one.select(*map(c, ctx.keys), few.alias(f"__x{i}")))
    out = parts[0].join(parts[1], list(ctx.keys), "full") if ctx.keys else parts[0].crossJoin(parts[1])  # one row each
    both = F.concat(*(F.coalesce(F.flatten(c(f"__x{i}")), F.array().cast(inputs[0].schema[name].dataType)) for i in (0, 1)))
    return out.filter(F.coalesce(F.size("__x0"), F.lit(0)) + F.coalesce(F.size("__x1"), F.lit(0)) > 0).select(*map(c, ctx.keys), both.alias(name), F.array(F.lit(0).cast("long")).alias(OCC))


def array_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return c(name)
    if isinstance(kind, T.StringType):  # JSON text
        parsed = F.from_json(c(name), "array<string>")
        return F.when(c(name).isNotNull() & parsed.isNull(), F.raise_error(F.lit(f"{name} holds no array")).cast("array<string>")).otherwise(parsed)
    raise ValueError(f"{name} is no array")


@lowers("flatten")
def _flatten(node, ctx, inputs):
    df, p = inputs[0], node.params
    kind = df.schema[p["column"]].dataType
    inner = kind.elementType
    none = F.array().cast(inner)
    return df.withColumn(p["output"], F.coalesce(F.flatten(F.transform(c(p["column"]), lambda x: F.coalesce(x, none))), none))


@lowers("explode")
def _explode(node, ctx, inputs):
    df, p = inputs[0], node.params
    keep = [x for x in df.columns if x not in (p["column"], OCC)]
    out = df.select(*map(c, keep), c(OCC), F.posexplode(array_column(df, p["column"])).alias("__pos", p["output"]))
    return out.withColumn(OCC, F.concat(OCC, F.array(c("__pos").cast("long"))))


@lowers("unnest")
def _unnest(node, ctx, inputs):
    df, p = inputs[0], node.params
    kind = df.schema[p["column"]].dataType
    if isinstance(kind, T.StructType):
        missing = [f for f, _ in p["fields"] if f not in kind.fieldNames()]
        if missing:
            raise ValueError(f"no field {missing}")
        return df.withColumns({out: c(p["column"]).getField(f) for f, out in p["fields"]}).drop(p["column"])
    parsed = F.from_json(c(p["column"]), "map<string,string>")
    found = {out: F.when(c(p["column"]).isNotNull() & ~F.coalesce(F.map_contains_key(parsed, f), F.lit(False)), F.raise_error(F.lit(f"no field {f}")).cast("string")).otherwise(parsed[f]) for f, out in p["fields"]}
    return df.withColumns(found).drop(p["column"])


def in_windows(ctx: Context, bound: dict[str, DataFrame], windows: DataFrame) -> Context:
    return replace(ctx, bound=bound, keys=("__win",), windows=windows, made={})
