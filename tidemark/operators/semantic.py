"""Semantic operators: a model decides, Spark finds the distinct tasks, spreads them and joins replies back.

Only the columns that an instruction names reach Python, equal tasks are asked once, and replies are stored
before anything reads them, so no lineage recomputation asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.model import PairwiseModel, Request, ask, keyed, placeholders, reads_ids, reads_keep, reads_label, reads_record, reads_rows, reads_text
from tidemark.operators.components import components
from tidemark.operators.nearest import COMPARES, KEYS, promising
from tidemark.operators.relational import OCC, Context, aggregate_column, c, lowers, pair_condition, suffixed
from tidemark.operators.windows import with_positions
from tidemark.plans.expressions import Expr
from tidemark.sources.store import State, store, stored

FAN = 64


def _equal(left: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of ``names`` with ``__k0``, ``__k1``, ... of the other side."""
    out = F.lit(True)
    for i, n in enumerate(names):
        out = out & left[f"`{n}`"].eqNullSafe(F.col(f"__k{i}"))
    return out


SLICE = 256  # rows that are Python objects at a time


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def records(batch: pa.RecordBatch, names: Sequence[str]) -> list[dict]:
    """A batch's rows as Python values (NaN is null, times are those of the session's zone) under ``names``."""
    return [dict(zip(names, r, strict=True)) for r in zip(*map(values, batch.columns), strict=True)]


def values(column: pa.Array) -> list:
    zoned = pa.types.is_timestamp(column.type) and column.type.tz
    found = column.to_pandas().dt.tz_convert(column.type.tz).dt.tz_localize(None).tolist() if zoned else column.to_pylist()
    return [None if _null(v) else v for v in found]


def asked(df: DataFrame, ctx: Context, kind: str, instruction: str, inputs: Sequence[str], result: str, read: Callable, said: Sequence[str] = ()) -> DataFrame:
    """Distinct ``inputs`` with the checked reply as ``__reply`` (type ``result``), stored. The model gets the values
    by the names ``said``, by default the columns'."""
    if ctx.model is None:
        raise ValueError("a semantic operator needs a model")
    model, said = ctx.model, list(said or inputs)
    tasks = df.select(*map(c, inputs)).distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields) + f", __reply {result}"

    kinds = pa.schema([to_arrow_schema(T.StructType([T.StructField("r", T._parse_datatype_string(result))])).field(0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            requests = [Request(kind, instruction, r) for r in records(part, said)]
            replies = pa.array(ask(model, requests, read), kinds.field(0).type)
            yield pa.RecordBatch.from_arrays([*part.columns, replies], names=[*part.schema.names, "__reply"])

    kept = ctx.options.get("__replies")  # of earlier steps, by question: what was asked is not asked again
    if kept is None:
        return stored(tasks.mapInArrow(run, schema), "replies")
    key = f"{kind}|{instruction}|{schema}"
    known = kept.get(key)
    if known is not None:
        tasks = stored(tasks, "tasks")
        before = known.frame(ctx.spark).select(*(c(n).alias(f"__k{i}") for i, n in enumerate(inputs)))
        fresh = tasks.join(before, _equal(tasks, inputs), "left_anti")
    path, made = store((tasks if known is None else fresh).mapInArrow(run, schema), "replies")
    kept[key] = (known or State(made.schema)).plus(path)
    return made if known is None else with_reply(tasks, kept[key].frame(ctx.spark), inputs)


def _null(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or v is pd.NaT


def with_reply(df: DataFrame, replies: DataFrame, inputs: Sequence[str]) -> DataFrame:
    right = replies.withColumnsRenamed({n: f"__in_{i}" for i, n in enumerate(inputs)})
    condition = F.lit(True)
    for i, n in enumerate(inputs):
        condition = condition & df[f"`{n}`"].eqNullSafe(right[f"__in_{i}"])
    return df.join(right, condition, "inner").drop(*(f"__in_{i}" for i in range(len(inputs))))


def with_key(df: DataFrame, ctx: Context, instruction: str, inputs: Sequence[str], name: str, said: Sequence[str] = ()) -> DataFrame:
    """With the model's key of ``inputs`` (see ``SameKey``): one question for each distinct value."""
    return with_reply(df, asked(df, ctx, "key", instruction, inputs, "string", str, said), inputs).withColumnRenamed("__reply", name)


@lowers("sem_key")
def _sem_key(node, ctx, inputs):
    p = node.params
    return with_key(inputs[0], ctx, p["instruction"], p["input_cols"], p["output"], p["said"])


def _inputs(instruction: str, columns: Sequence[str]) -> list[str]:
    found = []
    for p in placeholders(instruction):
        name = p if p in columns else p.split(":")[0]
        if name not in columns:
            raise ValueError(f"unknown placeholder {p}")
        found.append(name)
    return list(dict.fromkeys(found))


@lowers("sem_filter")
def _sem_filter(node, ctx, inputs):
    df, text = inputs[0], node.params["instruction"]
    names = _inputs(text, node.columns)
    replies = asked(df, ctx, "filter", text, names, "boolean", reads_keep(True))
    return with_reply(df, replies.filter("__reply"), names)


@lowers("sem_map")
def _sem_map(node, ctx, inputs):
    p, df = node.params, inputs[0]
    outs = p["output_cols"]
    kind = "struct<" + ",".join(f"`{o}`:string" for o in outs) + ">"
    out = with_reply(df, asked(df, ctx, "map", p["instruction"], p["input_cols"], kind, reads_record(outs)), p["input_cols"])
    return out.withColumns({o: c("__reply").getField(o) for o in outs})


@lowers("sem_flat_map")
def _sem_flat_map(node, ctx, inputs):
    p, df = node.params, inputs[0]
    outs = p["output_cols"]
    kind = "array<struct<" + ",".join(f"`{o}`:string" for o in outs) + ">>"
    replies = asked(df, ctx, "flat_map", p["instruction"], p["input_cols"], kind, reads_rows(outs))
    rows = with_reply(df, replies, p["input_cols"]).select("*", F.posexplode("__reply").alias("__ord", "__row"))
    rows = rows.withColumns({o: c("__row").getField(o) for o in outs} | {OCC: F.concat(OCC, F.array(c("__ord").cast("long")))})
    return rows.withColumn(p["ordinal_col"], c("__ord").cast("long")) if p["ordinal_col"] else rows


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector divided by its length, as doubles; null for a zero vector."""
    v = v.cast("array<double>")
    size = F.sqrt(_dot(v, v))
    return F.when(size > 0, F.transform(v, lambda e: e / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays in [-1, 1]; null for a zero vector."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(size > 0, _dot(a, b) / size)


UNROLLED = 512  # the widest vectors whose product is written out, so that it compiles


def product(a: Column, b: Column, width: int | None) -> Column:
    """Inner product of two arrays of ``width`` doubles (None: of any); null where their sizes differ."""
    if width is None or width > UNROLLED:
        return _dot(a, b)
    terms = [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(width)]
    while len(terms) > 1:
        terms = [x + y for x, y in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
    return F.when((F.size(a) == width) & (F.size(b) == width), terms[0])


def screened(pairs: DataFrame, profile: dict, left_id: Sequence[str], right_id: Sequence[str]) -> DataFrame:
    """Candidates by ``__score``: a threshold, then the best ``k`` for each row of the side ``per`` (left, right, or
    symmetric: a pair is among the best of either of its rows), ties by pair id."""
    out = pairs
    if profile.get("threshold") is not None:
        out = out.filter(c("__score") >= profile["threshold"])
    k, per = profile.get("k"), profile.get("per", "left")
    if k is None:
        return out
    order = [F.desc("__score"), *map(c, (*left_id, *right_id))]
    if per != "symmetric":
        best = Window.partitionBy(*map(c, left_id if per == "left" else right_id)).orderBy(*order)
        return out.withColumn("__n", F.row_number().over(best)).filter(c("__n") <= k).drop("__n")
    # Each pair stands at both its rows; it stays if it is among the best of one.
    ends = F.array(*(F.struct(*(c(x).alias(f"n{i}") for i, x in enumerate(side))) for side in (left_id, right_id)))
    at_both = out.withColumn("__end", F.explode(ends)).withColumn("__n", F.row_number().over(Window.partitionBy("__end").orderBy(*order)))
    chosen = at_both.filter(c("__n") <= k).select(*map(c, (*left_id, *right_id))).distinct()
    return out.join(chosen, [*left_id, *right_id], "left_semi")


def united(left: DataFrame, right: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame, int | None]:
    """Both sides with their unit vectors, made once a row, and the width of the left ones."""
    left = left.withColumn("__lu", unit(c(profile["left"])))
    right = right.withColumn("__ru", unit(c(profile["right"])))
    return left, right, left.agg(F.max(F.size("__lu"))).first()[0]


def scored(left: DataFrame, right: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with their unit vectors, and the score of a joined pair."""
    left, right, width = united(left, right, profile)
    return left, right, product(c("__lu"), c("__ru"), width)


def _profile(options: dict, name: str) -> dict | None:
    """The candidate profile, unless it leaves all to the model."""
    found = options.get(name)
    return None if not found or found.get("mode") == "oracle-only" else found


def _both(node, inputs: list[DataFrame]) -> list[DataFrame]:
    return [suffixed(df, n.columns, s, o) for df, n, s, o in zip(inputs, node.inputs, node.params["sides"], ("__l", "__r"), strict=True)]


def _in_domain(node, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that ``on`` leaves, of frames that have its columns."""
    on, sides = node.params["on"], node.params["sides"]
    if on and all(isinstance(e, Expr) for e in on):
        kinds = [{n: (d[f"{n}:{s}"], d.schema[f"{n}:{s}"].dataType) for n in x.columns if f"{n}:{s}" in d.columns} for d, x, s in zip((left, right), node.inputs, sides, strict=True)]
        return left.join(right, pair_condition(on, *kinds, sides))
    if not on:
        return left.crossJoin(right)  # the operator's own domain: every pair is a question
    condition = F.lit(True)
    for k in on:
        condition = condition & (left[f"{k}:{sides[0]}"] == right[f"{k}:{sides[1]}"])
    return left.join(right, condition)


def _compared(node, left: DataFrame, right: DataFrame) -> tuple[list, list] | None:
    """``on`` as equal keys and other comparisons of a column of each side, for ``promising``; None if it is more."""
    sides, keys, rest = node.params["sides"], [], []
    todo = [e if isinstance(e, Expr) else Expr("eq", (Expr("col", (e, sides[0])), Expr("col", (e, sides[1])))) for e in node.params["on"]]
    while todo:
        e = todo.pop()
        if e.op == "and":
            todo += e.args
            continue
        if e.op not in COMPARES or any(a.op != "col" for a in e.args) or {a.args[1] for a in e.args} != set(sides):
            return None
        op, (a, b) = e.op, e.args
        if a.args[1] != sides[0]:
            op, a, b = {"lt": "gt", "gt": "lt", "le": "ge", "ge": "le"}.get(op, op), b, a
        names = (f"{a.args[0]}:{sides[0]}", f"{b.args[0]}:{sides[1]}")
        kinds = [d.schema[n].dataType.simpleString() for d, n in zip((left, right), names, strict=True)]
        if kinds[0] != kinds[1] or kinds[0] not in KEYS:
            return None
        (keys.append((*names, False)) if op == "eq" else rest.append((op, *names)))
    return keys, rest


def _nearest(left: DataFrame, right: DataFrame, ids: tuple[str, str], keys: list, rest: list, profile: dict) -> DataFrame | None:
    """Pairs that ``profile`` screens, with all columns of both sides; None where every pair is a candidate."""
    if profile.get("k") is None and profile.get("threshold") is None:
        return None
    left, right, width = united(left, right, profile)
    if width is None or width < 1:
        return None
    found = screened(promising(left, right, ids, keys, rest, ("__lu", "__ru"), width, profile, UNROLLED), profile, [ids[0]], [ids[1]])
    return found.join(left.drop("__lu"), ids[0]).join(right.drop("__ru"), ids[1])


def candidate_pairs(node, ctx: Context, inputs: list[DataFrame]) -> DataFrame:
    """Pairs in the domain that ``on`` leaves, with both occurrence ids."""
    left, right = _both(node, inputs)
    profile = _profile(ctx.options, "pairs")
    if profile:
        known = _compared(node, left, right)
        near = _nearest(left, right, ("__l", "__r"), *known, profile) if known else None
        if near is not None:
            return near
        left, right, score = scored(left, right, profile)
    pairs = _in_domain(node, left, right)
    return screened(pairs.withColumn("__score", score).drop("__lu", "__ru"), profile, ["__l"], ["__r"]) if profile else pairs


def verified_pairs(node, ctx: Context, pairs: DataFrame) -> DataFrame:
    """Pairs that the model says yes to."""
    p = node.params
    said = {n: n.replace(":left", f":{p['sides'][0]}").replace(":right", f":{p['sides'][1]}") for n in placeholders(p["instruction"])}
    text = p["instruction"]
    for a, b in said.items():
        text = text.replace("{" + a + "}", "{" + b + "}")
    names = list(said.values())
    model = _Renamed(ctx.model, text, p["instruction"], said)
    replies = asked(pairs, Context(ctx.spark, {}, model), "join", text, names, "boolean", reads_keep(False))
    return with_reply(pairs, replies.filter("__reply"), names).drop("__reply")


def chosen_rows(node, ctx: Context, pairs: DataFrame, kind: str) -> DataFrame:
    """At most ``k`` right rows of each left one, chosen from a list. A left row's candidates are dealt to lists of
    about FAN, each list keeps at most k, and so on until one list is left; no prompt or task holds more.

    ``kind``: ``select`` keeps what fits, none to k; ``rank`` exactly k where there are more."""
    p, k = node.params, node.params["k"]
    left, right = ([x for x in node.columns if x.endswith(f":{s}")] for s in p["sides"])
    rule, model, fan = p["instruction"], ctx.model, max(FAN, 2 * k)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__o=pdf["__r"].map(tuple)).sort_values("__o").drop(columns="__o").reset_index(drop=True)
        first = {n.rpartition(":")[0]: _plain(pdf[n].iloc[0]) for n in left}
        items = [{"id": i, **{n.rpartition(":")[0]: _plain(r[n]) for n in right}} for i, r in enumerate(pdf.to_dict("records"))]
        most = min(k, len(items))
        asks = Request(kind, rule, {"query": first, "left": first, "items": items, "k": most})
        return pdf.iloc[ask(model, [asks], reads_ids(len(items), most if kind == "rank" else 0, most))[0]]

    while True:
        counts = pairs.groupBy("__l").agg(F.count(F.lit(1)).alias("__c"))
        most = counts.agg(F.max("__c")).first()[0] or 0
        lists = pairs.join(counts, "__l").withColumn("__g", F.pmod(F.xxhash64("__r"), F.ceil(c("__c") / fan)).cast("int"))
        kept = lists.filter(c("__c") <= k).drop("__c", "__g") if kind == "rank" else None
        lists = lists.filter(c("__c") > k) if kind == "rank" else lists
        out = lists.drop("__c").groupBy("__l", "__g").applyInPandas(lambda pdf: best(pdf.drop(columns="__g")), pairs.schema)
        pairs = stored(out if kept is None else out.unionByName(kept), "chosen")
        if most <= fan:
            return pairs


def _plain(v):
    """A value for a prompt."""
    return None if _null(v) else v.tolist() if hasattr(v, "tolist") else v


def kept_pairs(node, ctx: Context, pairs: DataFrame) -> DataFrame:
    """Without ``k`` the pairs that the model confirms. With ``k``: the best by score where only scores decide, else a
    choice from lists, or (``topk_method`` pairwise, quick or heap) confirmed pairs ranked by comparisons."""
    p = node.params
    by_score = (ctx.options.get("pairs") or {}).get("mode") == "proxy-only"
    if p["k"] is None:
        return pairs if by_score else verified_pairs(node, ctx, pairs)
    if by_score:
        best = Window.partitionBy("__l").orderBy(F.desc("__score"), "__r")
        return pairs.withColumn("__n", F.row_number().over(best)).filter(c("__n") <= p["k"]).drop("__n")
    pairs = pairs.drop("__score")
    method = ctx.options.get("topk_method", "listwise")
    if method == "listwise":
        return chosen_rows(node, ctx, stored(pairs, "pairs"), "select")
    ranking = Context(ctx.spark, {}, PairwiseModel(ctx.model, {"pairwise": "naive"}.get(method, method)), options=ctx.options)
    return chosen_rows(node, ranking, stored(verified_pairs(node, ctx, pairs), "pairs"), "rank")


SALT = 5_000_000  # pairs that one share of a join makes


def confirmed(node, ctx: Context, left: DataFrame, right: DataFrame) -> tuple[DataFrame, list[list[str]]] | None:
    """Distinct values of the columns that the question and ``on`` name, of both sides, that the model joins: as ``__a0``, ...
    and ``__b0``, .... None where a side has no such column."""
    p, sides = node.params, node.params["sides"]
    text = [(x.replace(":left", f":{sides[0]}").replace(":right", f":{sides[1]}")) for x in placeholders(p["instruction"])]
    on = [x for e in p["on"] for x in (e.columns() if isinstance(e, Expr) else ((e, s) for s in sides))]
    named = []
    for n, s, other in zip(node.inputs, sides, sides[::-1], strict=True):
        names = [x for x in text if x.rpartition(":")[2] == s and x.rpartition(":")[0] in n.columns]
        names += sorted(f"{x}:{s}" for x, q in on if (q == s or (q != other and x in n.columns)))
        named.append(list(dict.fromkeys(names)))
    if not all(named) or any(x not in (*named[0], *named[1]) for x in text):
        return None
    values = [df.select(*map(c, names)).distinct() for df, names in zip((left, right), named, strict=True)]
    found = verified_pairs(node, ctx, _in_domain(node, *values))
    return stored(found.select(*(c(x).alias(f"__{s}{i}") for s, names in zip("ab", named, strict=True) for i, x in enumerate(names))), "confirmed"), named


def _same(df: DataFrame, names: Sequence[str], other: DataFrame, mark: str) -> Column:
    out = F.lit(True)
    for i, n in enumerate(names):
        out = out & df[f"`{n}`"].eqNullSafe(other[f"__{mark}{i}"])
    return out


def confirmed_pairs(left: DataFrame, right: DataFrame, yes: DataFrame, named: list[list[str]]) -> DataFrame:
    """Rows of both sides whose values are confirmed. Where few values make many pairs, the rows of a value on the right
    are dealt to shares, each of which meets all its rows on the left."""
    counts = []
    for df, names, mark in zip((left, right), named, "ab", strict=True):
        sizes = df.groupBy(*map(c, names)).agg(F.count(F.lit(1)).cast("double").alias(f"__n{mark}"))
        counts.append(sizes.select(*(c(x).alias(f"__{mark}{i}") for i, x in enumerate(names)), f"__n{mark}"))
    made = yes
    for x, mark, names in zip(counts, "ab", named, strict=True):
        x = x.withColumnsRenamed({f"__{mark}{i}": f"__{mark}{i}x" for i in range(len(names))})
        same = F.lit(True)
        for i in range(len(names)):
            same = same & made[f"__{mark}{i}"].eqNullSafe(x[f"__{mark}{i}x"])
        made = made.join(x, same)
    total = made.agg(F.sum(F.col("__na") * F.col("__nb"))).first()[0] or 0
    shares = min(64, -(-int(total) // SALT))
    first = left.join(yes, _same(left, named[0], yes, "a")).drop(*(f"__a{i}" for i in range(len(named[0]))))
    if shares <= 1:
        return first.join(right, _same(right, named[1], first, "b")).drop(*(f"__b{i}" for i in range(len(named[1]))))
    first = first.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).hint("merge")
    right = right.withColumn("__own", F.pmod(F.xxhash64("__r"), F.lit(shares)).cast("int")).hint("merge")
    both = first.join(right, _same(right, named[1], first, "b") & (c("__share") == c("__own")))
    return both.drop("__share", "__own", *(f"__b{i}" for i in range(len(named[1]))))


class _Renamed:
    """Gives the model the instruction and value names as the author wrote them."""

    def __init__(self, model, text, rule, said):
        self.model, self.text, self.rule, self.back = model, text, rule, {b: a for a, b in said.items()}

    def answer(self, requests):
        return self.model.answer([Request(r.kind, self.rule, {self.back[k]: v for k, v in r.values.items()}) for r in requests])


@lowers("sem_join")
def _sem_join(node, ctx, inputs):
    p, sides = node.params, node.params["sides"]
    left, right = _both(node, inputs)
    whole = confirmed(node, ctx, left, right) if p["k"] is None and not _profile(ctx.options, "pairs") else None
    pairs = kept_pairs(node, ctx, candidate_pairs(node, ctx, inputs)) if whole is None else confirmed_pairs(left, right, *whole)
    pairs = pairs.withColumn(OCC, F.concat("__l", "__r"))
    if p["how"] == "inner":
        return pairs
    if whole is not None:  # a row without a pair is one whose values none was confirmed with
        out = pairs.select(*map(c, node.columns), OCC)
        for i, (df, own, how) in enumerate(((left, "__l", ("left", "outer")), (right, "__r", ("right", "outer")))):
            if p["how"] in how:
                values = whole[0].select(*(f"__{'ab'[i]}{n}" for n in range(len(whole[1][i])))).distinct()
                alone = df.join(values, _same(df, whole[1][i], values, "ab"[i]), "left_anti").withColumn(OCC, F.concat(F.array(F.lit((1 << 63) - 1)) if i else F.array().cast("array<bigint>"), own))
                out = out.unionByName(alone.drop("__l", "__r"), allowMissingColumns=True)
        return out
    pairs = stored(pairs.select(*map(c, node.columns), "__l", "__r", OCC), "pairs")
    out = pairs
    for i, how in ((0, ("left", "outer")), (1, ("right", "outer"))):
        if p["how"] in how:
            occ = ("__l", "__r")[i]
            alone = suffixed(inputs[i], node.inputs[i].columns, sides[i], occ).join(pairs.select(occ).distinct(), occ, "left_anti")
            out = out.unionByName(alone.withColumn(OCC, F.concat(F.array(F.lit((1 << 63) - 1)) if i else F.array().cast("array<bigint>"), occ)), allowMissingColumns=True)
    return out


@lowers("sem_groupby")
def _sem_groupby(node, ctx, inputs):
    p, df = node.params, inputs[0]
    names = list(p["input_cols"])
    if p["labels"]:
        labels = [n for n, _ in p["labels"]]
        return with_reply(df, asked(df, ctx, "label", p["instruction"], names, "string", reads_label(labels)), names).withColumn(p["group_col"], c("__reply"))
    keys = list(dict.fromkeys([*names, *p["partition_by"], *ctx.keys]))
    nodes = stored(with_positions(df.groupBy(*map(c, keys)).agg(F.min(OCC).alias(OCC)), "__id"), "keys")
    a, b = (nodes.select(*(c(k).alias(f"{k}:{s}") for k in keys), c("__id").alias(f"__{s}")) for s in ("left", "right"))
    profile = _profile(ctx.options, "groups")
    if not profile and keyed(ctx.model, p["instruction"]):  # rows of one key are linked, so their first one is the root
        same = [*p["partition_by"], *ctx.keys, "__key"]
        known = stored(with_key(nodes, ctx, p["instruction"], names, "__key"), "known")
        roots = known.groupBy(*map(c, same)).agg(F.min("__id").alias("__reply"))
        return with_reply(df, with_reply(known, roots, same).select(*map(c, keys), "__reply"), keys).withColumn(p["group_col"], c("__reply"))
    if profile:
        profile = {"left": f"{profile['column']}:left", "right": f"{profile['column']}:right", **profile}
    within = (*p["partition_by"], *ctx.keys)
    pairs = None
    if profile and all(nodes.schema[k].dataType.simpleString() in KEYS for k in within):
        pairs = _nearest(a, b, ("__left", "__right"), [(f"{k}:left", f"{k}:right", True) for k in within], [("lt", "__left", "__right")], profile)
    if pairs is None:
        if profile:
            a, b, score = scored(a, b, profile)
        condition = c("__left") < c("__right")
        for k in within:
            condition = condition & a[f"`{k}:left`"].eqNullSafe(b[f"`{k}:right`"])
        pairs = a.join(b, condition)
        if profile:
            pairs = screened(pairs.withColumn("__score", score).drop("__lu", "__ru"), profile, ["__left"], ["__right"])
    if not profile or profile.get("mode") != "proxy-only":
        sides = [f"{n}:{s}" for n in names for s in ("left", "right")]
        pairs = with_reply(pairs, asked(pairs, ctx, "same", p["instruction"], sides, "boolean", reads_keep(False)).filter("__reply"), sides)
    roots = components(pairs.select("__left", "__right"), "__left", "__right")
    grouped = nodes.join(roots, nodes["__id"] == roots["node"], "left").select(*map(c, keys), F.coalesce("root", "__id").alias("__reply"))
    return with_reply(df, grouped, keys).withColumn(p["group_col"], c("__reply"))


def _fold(model, instruction: str, budget: int):
    """Folds ordered items to one text, as many at a time as fit in ``budget`` characters."""

    def run(items: list, kind: str = "agg") -> str | None:
        while True:
            parts, size = [[]], 0
            for x in items:
                n = len(str(x))
                if n > budget:
                    raise ValueError("an item is longer than the model's context")
                if size + n > budget and parts[-1]:
                    parts.append([])
                    size = 0
                parts[-1].append(x)
                size += n
            folded = ask(model, [Request(kind, instruction, {"items": part}) for part in parts], reads_text)
            if len(folded) == 1:
                return folded[0]
            items, kind = folded, "agg_state"

    return run


def _last(model, instruction: str, budget: int, outputs: Sequence[str]):
    """Of texts folded so far, the aggregate's outputs: one is the text itself, several are asked for in a last pass."""
    fold = _fold(model, instruction, budget)

    def run(texts: list) -> dict:
        if len(outputs) == 1:
            return {outputs[0]: texts[0] if len(texts) == 1 else fold(texts, "agg_state")}
        if sum(len(str(x)) for x in texts) > budget:
            texts = [fold(texts, "agg_state")]
        return ask(model, [Request("agg_final", instruction, {"items": texts, "final": True})], reads_record(outputs))[0]

    return run


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Stretches of rows that are equal in their first ``width`` columns: these, and the rows' others."""
    key, rows = None, []
    for batch in slices(batches):
        for r in zip(*map(values, batch.columns), strict=True):
            if rows and r[:width] != key:
                yield key, rows
                rows = []
            key = r[:width]
            rows.append(r[width:])
    if rows:
        yield key, rows


def by_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, made: Callable[[tuple, list[tuple]], tuple]) -> DataFrame:
    """``made`` of each group's key and of its rows in order. A task streams through many groups and holds one."""
    kinds = to_arrow_schema(T._parse_datatype_string(schema))
    dealt = df.repartition(*map(c, keys)) if keys else df.repartition(1)
    rows = dealt.sortWithinPartitions(*map(c, (*keys, *order))).select(*map(c, keys), *(c(x) for x in df.columns if x not in (*keys, OCC)))
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batched((made(*r) for r in _runs(batches, width)), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, schema)


LEAF = 4096  # rows that a leaf of a fold takes


def semantic_aggregate(node, ctx: Context, df: DataFrame) -> DataFrame:
    """Semantic specs by a fold in levels (stretches of arrival, then FAN of their texts at a time, then groups), others
    natively, joined on the keys. No task takes more than LEAF rows or FAN texts of a group."""
    keys = list(dict.fromkeys([*ctx.keys, *node.params["keys"]]))
    hidden = [f"__k{i}" for i in range(len(keys))]
    df = df.withColumns({h: F.coalesce(c(k).cast("string"), F.lit("\x00null")) for h, k in zip(hidden, keys, strict=True)})
    rest = [aggregate_column(df, s).alias(s.output) for s in node.params["specs"] if s.kind != "sem_agg"]
    out = df.groupBy(*hidden).agg(*(F.first(c(k)).alias(k) for k in keys), *rest, F.min(OCC).alias(OCC))
    budget, model = ctx.options.get("max_chars", 100_000), ctx.model
    begin = "".join(f"{h} string, " for h in hidden)
    for s in (s for s in node.params["specs"] if s.kind == "sem_agg"):
        fold, last = _fold(model, s.options[0], budget), _last(model, s.options[0], budget, s.outputs)
        part = with_positions(df.select(*hidden, *map(c, dict.fromkeys(s.columns)), OCC)).withColumn("__b", F.floor(c("__pos") / LEAF).cast("long")).drop("__pos")
        part = part.select(*hidden, "__b", OCC, *(c(x).alias(f"__v{i}") for i, x in enumerate(s.columns)))
        state = f"{begin}__b long, __x string"
        low = stored(by_runs(part, [*hidden, "__b"], [OCC], state, lambda key, rows, s=s, fold=fold: (*key, fold([r[0] if len(r) == 1 else dict(zip(s.columns, r, strict=True)) for r in rows]))), "fold")
        while low.groupBy(*hidden).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FAN).take(1):
            higher = low.withColumn("__up", F.floor(c("__b") / FAN).cast("long")).select(*hidden, "__up", "__b", "__x")
            low = stored(by_runs(higher, [*hidden, "__up"], ["__b"], state, lambda key, rows, fold=fold: (*key, rows[0][1] if len(rows) == 1 else fold([r[1] for r in rows], "agg_state"))), "fold")
        high = stored(by_runs(low, hidden, ["__b"], begin + ", ".join(f"`{o}` string" for o in s.outputs), lambda key, rows, s=s, last=last: (*key, *(said[o] for said in [last([r[1] for r in rows])] for o in s.outputs))), "fold")
        out = out.join(high, hidden) if hidden else out.crossJoin(high)  # one row each
    return out


@lowers("sem_fold")
def _sem_fold(node, ctx, inputs):
    """Over a frame: one fold for each row; an empty frame gives nulls without a question."""
    p, model, df = node.params, ctx.model, inputs[0]
    budget, outputs = ctx.options.get("max_chars", 100_000), p["outputs"]
    fold, last = _fold(model, p["instruction"], budget), _last(model, p["instruction"], budget, outputs)

    @F.pandas_udf(", ".join(f"`{o}` string" for o in outputs))
    def run(frames: pd.Series) -> pd.DataFrame:
        import json

        items = [[next(iter(x.values())) if len(x) == 1 else x for x in json.loads(f)] for f in frames]
        return pd.DataFrame([last([fold(x)]) if x else dict.fromkeys(outputs) for x in items], columns=list(outputs))

    said = F.to_json(c(p["column"]), {"ignoreNullFields": "false"})
    made = df.withColumn("__made", run(said)).withColumns({o: c("__made").getField(o) for o in outputs})
    return stored(made.select(*map(c, node.columns), *map(c, ctx.keys), OCC), "folds")


@lowers("sem_topk")
def _sem_topk(node, ctx, inputs):
    """Listwise: rounds of FAN rows each keep their best k, until one list is left. Adds no columns."""
    p, model, df = node.params, ctx.model, inputs[0]
    k, instruction = p["k"], p["instruction"] or ctx.options["query"]
    rule = ctx.options.get("rank_rule", instruction)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__o=pdf[OCC].map(tuple)).sort_values("__o").drop(columns="__o").reset_index(drop=True)
        items = [{"id": i, **{n: r[n] for n in node.columns}} for i, r in enumerate(pdf.to_dict("records"))]
        want = min(k, len(items))

        order = ask(model, [Request("rank", rule, {"query": instruction, "items": items, "k": want})], reads_ids(len(items), want, want))[0]
        return pdf.iloc[order].assign(__rank=range(len(order)))

    rows = df.select(*map(c, node.columns), OCC).withColumn("__rank", F.lit(0).cast("long"))
    fan = max(FAN, 2 * k)
    while True:
        n = rows.count()
        group = with_positions(rows).withColumn("__g", F.floor(c("__pos") / fan)).drop("__pos")
        rows = stored(group.groupBy("__g").applyInPandas(lambda pdf: best(pdf.drop(columns=["__g"])), rows.schema), "ranked")
        if n <= fan:
            return rows.withColumn(OCC, F.concat(F.array("__rank"), OCC))
