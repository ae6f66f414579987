"""Messages as templates and variables, without loss: a fixed-depth token tree (Drain, He et al., ICWS 2017) as joins and sums.

A message is its tokens between spaces, the last of which holds what is left of a long one. Tokens with a digit, very long ones and that
last one are variables. What remains is the message's shape, and messages are counted by shape first. A leaf of the tree is a number of
tokens and the first tokens of the shape. Within a leaf, rounds of merging: the most frequent shape that has no group yet leads one, and
each shape that agrees with it in half of its tokens or more joins it. A shape is compared with one other a round, whatever the
leaf holds. A group's template has the tokens that all of its shapes have, and variables elsewhere. Messages of groups that are too rare
to pay share one template, a variable alone.

A row then has its template's id and its variables in order, and the message is put together from the two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia import shared
from obsidia.functions.redact import short_hash

ANY = "<*>"
#: Parts that the shapes of one leaf are dealt to when they are compared with the leaf's leader.
SPLIT = 16


@dataclass(frozen=True)
class Settings:
    """tokens of a message at most, the last with all that is left; characters of a constant token at most; tokens that name a leaf; share of tokens that must agree;
    rounds of merging; messages that a template has at least."""

    tokens: int = 64
    longest: int = 64
    lead: int = 1
    agree: float = 0.5
    rounds: int = 4
    support: int = 5


SETTINGS = Settings()


def _tokens(message: Column, s: Settings) -> Column:
    return F.split(message, " ", s.tokens)


def _shape(tokens: Column, s: Settings) -> Column:
    """The tokens with variables in place; a token that looks like the mark of a variable is one."""
    varies = lambda t, i: t.rlike("[0-9]") | (F.length(t) > s.longest) | (t == ANY) | (i == s.tokens - 1)
    return F.transform(tokens, lambda t, i: F.when(varies(t, i), ANY).otherwise(t))


def _agree(a: Column, b: Column) -> Column:
    """How many tokens two shapes of one length have in common; variables don't count."""
    same = F.zip_with(a, b, lambda x, y: ((x == y) & (x != ANY)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x)


def mine(messages: DataFrame, settings: Settings = SETTINGS, column: str = "message") -> tuple[DataFrame, DataFrame]:
    """Templates, and shapes with the template of each. Templates: template_id, template (its tokens), messages. Shapes: shape, template_id.

    A null message has no template. The catch-all template, one variable, has all messages of rarer groups; it comes if there are such.
    """
    s = settings
    counted = messages.where(F.col(f"`{column}`").isNotNull()).select(_shape(_tokens(F.col(f"`{column}`"), s), s).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
    leaf = F.struct(F.size("shape").alias("size"), F.slice("shape", 1, s.lead).alias("lead"))
    left = shared.written(counted.withColumn("leaf", leaf), "shapes")
    grouped = None
    for number in range(s.rounds):
        leads = left.groupBy("leaf").agg(F.max(F.struct("n", "shape")).alias("top")).select("leaf", F.col("top.shape").alias("lead_shape"))
        spread = leads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
        met = left.withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(SPLIT)).cast("int")).join(spread, ["leaf", "part"])
        joins = (F.col("shape") == F.col("lead_shape")) | (_agree(F.col("shape"), F.col("lead_shape")) >= s.agree * F.size("shape"))
        compared = shared.written(met.select("shape", "n", "leaf", "lead_shape", joins.alias("joins")), "compared")
        taken = compared.where("joins").select("shape", "n", F.col("lead_shape").alias("leader"))
        grouped = taken if grouped is None else grouped.unionByName(taken)
        left = compared.where("NOT joins").select("shape", "n", "leaf")
    alone = left.select("shape", "n", F.col("shape").alias("leader"))
    members = alone if grouped is None else grouped.unionByName(alone)
    groups = members.groupBy("leader").agg(F.sum("n").alias("messages")).where(F.col("messages") >= s.support)
    kept = members.join(groups.select("leader"), "leader")
    at = kept.select("leader", F.posexplode("shape").alias("i", "token")).groupBy("leader", "i").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    token = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(ANY)
    made = at.groupBy("leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", token.alias("token")))), lambda x: x["token"]).alias("template"))  # settings.tokens at most
    named = members.join(made, "leader", "left").withColumn("template", F.coalesce("template", F.array(F.lit(ANY))))
    named = shared.written(named.select("shape", "n", "template", template_id(F.col("template")).alias("template_id")), "named")
    return named.groupBy("template_id", "template").agg(F.sum("n").alias("messages")), named.select("shape", "template_id", "template")


def template_id(template: Column) -> Column:
    return short_hash(F.array_join(template, " "))


def encode(messages: DataFrame, shapes: DataFrame, settings: Settings = SETTINGS, column: str = "message") -> DataFrame:
    """The rows with template_id and variables in place of the message; null both where it is null.

    A message whose shape was not mined, as one that came later, has the catch-all template.
    """
    tokens, text = _tokens(F.col(f"`{column}`"), settings), F.col(f"`{column}`")
    rows = messages.withColumn("_shape", _shape(tokens, settings)).join(shapes.withColumnRenamed("shape", "_shape"), "_shape", "left")
    whole = F.col("template").isNull() | (F.array_join("template", " ") == ANY)
    held = F.transform(F.filter(F.zip_with(tokens, F.col("template"), lambda t, p: F.struct(t.alias("t"), p.alias("p"))), lambda x: x["p"] == ANY), lambda x: x["t"])
    named = {"template_id": F.when(text.isNotNull(), F.coalesce("template_id", template_id(F.array(F.lit(ANY))))), "variables": F.when(text.isNotNull(), F.when(whole, F.array(text)).otherwise(held))}
    return rows.withColumns(named).select(*[F.col(f"`{c}`") for c in messages.columns if c != column], "template_id", "variables")


def decode(rows: DataFrame, templates: DataFrame, column: str = "message") -> DataFrame:
    """The rows of encode() with the message again."""
    places = F.transform("template", lambda t, i: F.when(t == ANY, F.size(F.filter(F.slice(F.col("template"), 1, i + 1), lambda x: x == ANY)) - 1))
    known = templates.select("template_id", "template", places.alias("_places"))
    catch_all = F.coalesce("template", F.array(F.lit(ANY)))
    put = F.transform(F.arrays_zip(catch_all.alias("t"), F.coalesce("_places", F.array(F.lit(0))).alias("p")), lambda x: F.when(x["t"] == ANY, F.get("variables", x["p"])).otherwise(x["t"]))
    out = rows.join(known, "template_id", "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("template_id", "variables")], F.when(F.col("template_id").isNotNull(), F.array_join(put, " ")).alias(column))
