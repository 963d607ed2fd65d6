"""Evaluating a value once, however often an expression uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(body, **values: Column) -> Column:
    """body(bound), bound[name] being the value of that name."""
    bound = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.transform(F.array(bound), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for an operator's own use that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def scanned(items: Column, zero: Column, step, kind: str) -> Column:
    """array<kind> of what step makes of each item in order: step(state, item) is (next state, output).

    Outputs are put together in about as many blocks as a block has items, since an array that grows is copied at each step."""
    empty = lambda kind: F.expr(f"cast(array() as {kind})")

    def one(done: Column, item: Column) -> Column:
        state, output = step(done["state"], item)
        return F.struct(state.alias("state"), F.concat(done["found"], F.array(output)).alias("found"))

    def block(done: Column, items: Column) -> Column:
        begun = F.struct(done["state"].alias("state"), empty(f"array<{kind}>").alias("found"))
        return F.aggregate(items, begun, one, lambda x: F.struct(x["state"].alias("state"), F.concat(done["blocks"], F.array(x["found"])).alias("blocks")))

    def blocks(b: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(b["items"]))).cast("int"), F.lit(1))
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(b["items"]) / width).cast("int")), lambda k: F.slice(b["items"], k * width + 1, width))
        begun = F.struct(zero.alias("state"), empty(f"array<array<{kind}>>").alias("blocks"))
        return F.aggregate(cut, begun, block, lambda x: F.flatten(x["blocks"]))

    return F.when(items.isNotNull(), let(blocks, items=items))
