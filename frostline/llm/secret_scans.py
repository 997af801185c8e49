"""Secret scans in DataFrame functions alone: fixed patterns, and character Markov models of random strings and of
ordinary identifiers, compared by log-likelihood ratio.

Positions come from splitting a text at a pattern: the gaps and the hits, in order, add up to the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.text import let

# Fixed patterns. The lower bounds of hex and access hold whole runs, so they find what the runs of that length are.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")  # the order among spans that start together
LEAST_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
TOKEN = r"[A-Za-z0-9+/_-]{%d,}"


@dataclass(frozen=True)
class Settings:
    """min_length: characters of a token that is judged. train_length: of one that trains the models.

    prior: share of random strings among such tokens; the ratio must outweigh it. smoothing: added to every count.
    novel: share of a new token's characters that don't depend on the one before, but come as often as in all samples of
    their class: a word with a pair that no sample holds isn't random for that. min_distinct: different characters of a random string; rulers and fillers have fewer.
    """

    min_length: int = 16
    train_length: int = 8
    prior: float = 1e-4
    smoothing: float = 0.5
    novel: float = 0.2
    min_distinct: int = 7


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of characters, row by row in the order of ALPHABET."""

    ratios: tuple[float, ...]


def labelled_samples(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """token, is_random: the samples that the models are trained from, taken from all documents.

    Random strings are what the access and hex patterns match, and digests of the ids in hex and base64; ordinary
    identifiers are all other runs of letters and digits. Null texts give none.
    """
    some = documents.where(F.col("text").isNotNull())
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    known = F.concat(F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
                     F.array(digest, F.upper(digest), F.translate(F.base64(F.unhex(digest)), "=", "")))
    plain = F.filter(F.regexp_extract_all("text", F.lit(TOKEN % settings.train_length), F.lit(0)),
                     lambda t: ~t.rlike(f"{HEX}|{ACCESS}"))
    return some.select(F.explode(known).alias("token"), F.lit(True).alias("is_random")).unionByName(
        some.select(F.explode(plain).alias("token"), F.lit(False).alias("is_random"))
    )


def _identifiers(word: Column) -> Column:
    """A word of letters as it stands in identifiers: camel and Pascal case, with _ and -, in capitals, in paths, and
    with a number after it. A word is joined to itself, so that all ends and beginnings of words meet somewhere."""
    low, number = F.lower(word), F.pmod(F.xxhash64(word), F.lit(100)).cast("string")
    title, capitals = F.initcap(low), F.upper(word)
    return F.array(
        F.concat(low, title, title), F.concat(title, title, number), F.concat(low, F.lit("_"), low, number),
        F.concat(capitals, F.lit("_"), capitals), F.concat(low, F.lit("-"), low, F.lit("-"), title),
        F.concat(F.lit("/"), low, F.lit("/"), low, number, F.lit("/"), low),
        F.concat(low, number, F.lit("_"), low), F.concat(number, F.lit("-"), low, F.lit("_"), number),
    )


def train(samples: DataFrame, settings: Settings = Settings()) -> Model:
    """Transition models from labelled samples (token, is_random).

    Ordinary tokens of letters alone also count in the shapes of identifiers made of them. Equal tokens are counted
    before they are taken apart. Only counts of pairs reach the driver, at most 2 * len(ALPHABET)^2. A class without
    samples is uniform. Characters outside the alphabet are left out.
    """
    letters = F.split("token", "")
    counted = samples.where(F.length("token") >= 2).groupBy("is_random", "token").agg(F.count("*").alias("n"))
    shaped = F.when(~F.col("is_random") & F.col("token").rlike(r"^[A-Za-z]+\z"), _identifiers(F.col("token")))
    forms = F.concat(F.array("token"), F.coalesce(shaped, F.array().cast("array<string>")))
    pairs = counted.select("is_random", "n", F.explode(forms).alias("token")).select(
        "is_random", "n",
        F.explode(let(letters, lambda c: F.transform(
            F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1))
        ))).alias("pair"),
    ).where(F.col("pair").rlike(r"^[A-Za-z0-9+/_-]{2}\z"))
    counts = {(r.is_random, r.pair): r.n for r in pairs.groupBy("is_random", "pair").agg(F.sum("n").alias("n")).collect()}
    size, ratios = len(ALPHABET), []
    seconds = {(kind, x): sum(counts.get((kind, first + x), 0) for first in ALPHABET) for kind in (True, False) for x in ALPHABET}
    seen = {kind: sum(seconds[kind, x] for x in ALPHABET) for kind in (True, False)}
    for first in ALPHABET:
        sums = {kind: sum(counts.get((kind, first + x), 0) for x in ALPHABET) for kind in (True, False)}
        for second in ALPHABET:
            chance = {
                kind: settings.novel * (seconds[kind, second] + settings.smoothing) / (seen[kind] + settings.smoothing * size)
                + (1 - settings.novel) * (counts.get((kind, first + second), 0) + settings.smoothing)
                / (sums[kind] + settings.smoothing * size)
                for kind in (True, False)
            }
            ratios.append(math.log(chance[True] / chance[False]))
    return Model(tuple(ratios))


def log_ratio(token: Column, model: Model) -> Column:
    """Sum over the token's pairs; positive: rather a random string. In time proportional to its length."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model.ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(codes, lambda c: F.aggregate(
        F.sequence(F.lit(2), F.size(c)), F.lit(0.0),
        lambda total, i: total + F.element_at(
            table, ((F.element_at(c, (i - 1).cast("int")) - 1) * len(ALPHABET) + F.element_at(c, i.cast("int"))).cast("int")),
    ))


def _running_sums(numbers: Column) -> Column:
    """Sum up to each element, in blocks of about sqrt(n): n * sqrt(n) steps for the longest arrays."""

    def blocks(a: Column) -> Column:
        def with_size(b: Column) -> Column:
            total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
            count = F.ceil(F.size(a) / b).cast("int")
            sums = F.transform(F.sequence(F.lit(0), count - 1), lambda k: total(F.slice(a, k * b + 1, b)))
            def with_sums(s: Column) -> Column:
                before = F.transform(F.sequence(F.lit(0), count - 1), lambda k: total(F.slice(s, F.lit(1), k)))
                return let(before, lambda p: F.transform(
                    F.sequence(F.lit(0), F.size(a) - 1),
                    lambda i: F.element_at(p, F.floor(i / b).cast("int") + 1)
                    + total(F.slice(a, F.floor(i / b).cast("int") * b + 1, i % b + 1)),
                ))
            return let(sums, with_sums)
        return let(F.greatest(F.lit(1), F.floor(F.sqrt(F.size(a))).cast("int")), with_size)

    return let(numbers, blocks)


def _hits(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (start, end, hit, value) of a pattern's matches; the text must have one."""
    parts = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0)).alias("values"),
    )

    def placed(p: Column) -> Column:
        steps = F.transform(
            F.sequence(F.lit(1), F.size(p["hits"])),
            lambda i: (F.element_at(p["gaps"], i) + F.when(i > 1, F.length(F.get(p["hits"], i - 2))).otherwise(0)).cast("long"),
        )
        return let(_running_sums(steps), lambda s: F.transform(
            F.sequence(F.lit(1), F.size(p["hits"])),
            lambda i: F.struct(
                F.element_at(s, i).alias("start"),
                (F.element_at(s, i) + F.length(F.element_at(p["hits"], i))).alias("end"),
                F.element_at(p["hits"], i).alias("hit"), F.element_at(p["values"], i).alias("value"),
            ),
        ))

    return let(parts, placed)


SPAN = "struct<start:bigint,rank:int,end:bigint>"


def _spans(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), h["end"].alias("end")
    ))


def _none(kind: str = f"array<{SPAN}>") -> Column:
    return F.array().cast(kind)


def _is_random(token: Column, model: Model, settings: Settings) -> Column:
    varied = F.size(F.array_distinct(F.split(token, ""))) >= settings.min_distinct
    return varied & (log_ratio(token, model) >= F.lit(math.log((1 - settings.prior) / settings.prior)))


def scan(text: Column, model: Model, settings: Settings = Settings()) -> Column:
    """All spans of a text, an array of (start, rank, end) by start, then kind: rank is the place in KINDS.

    Offsets count code points, the end is exclusive. Null and empty texts have none. The Markov span of a token is
    added where no fixed pattern already reports its run.
    """
    text = F.coalesce(text, F.lit(""))
    token = TOKEN % settings.min_length
    assign = F.when(text.rlike(ASSIGN), _spans(
        F.filter(_hits(text, ASSIGN, 2), lambda h: F.length(h["value"]) >= LEAST_VALUE), "assign")).otherwise(_none())
    access = F.when(text.rlike(ACCESS), _spans(_hits(text, ACCESS), "access")).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(_hits(text, HEX), "hex")).otherwise(_none())

    def judged(piece: Column, base: Column) -> Column:
        found = F.filter(_hits(piece, token),
                         lambda h: ~h["hit"].rlike(f"{HEX}|{ACCESS}") & _is_random(h["hit"], model, settings))
        spans = F.transform(found, lambda h: F.struct(
            (h["start"] + base).alias("start"), F.lit(3).alias("rank"), (h["end"] + base).alias("end")))
        return F.when(piece.rlike(token), spans).otherwise(_none())

    # Tokens are looked for between the assignments, which have their spans already.
    def between(hits: Column) -> Column:
        edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(hits, lambda h: h["end"]))
        return let(F.struct(F.split(text, ASSIGN, -1).alias("pieces"), edges.alias("edges")), lambda x: F.flatten(
            F.transform(F.sequence(F.lit(1), F.size(x["pieces"])),
                        lambda i: judged(F.element_at(x["pieces"], i), F.element_at(x["edges"], i)))))

    markov = F.when(text.rlike(token), F.when(text.rlike(ASSIGN), let(_hits(text, ASSIGN), between)).otherwise(
        judged(text, F.lit(0).cast("long")))).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes, markov))


def scanned(documents: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id and spans of every whole text, one row per document row; an empty table gives no rows."""
    return documents.select("doc_id", scan(F.col("text"), model, settings).alias("spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


PLACEHOLDER = "[SECRET]"


def redacted(text: Column, model: Model, settings: Settings = Settings()) -> Column:
    """The text with every secret replaced; of an assignment only the value. Null stays null."""
    token = TOKEN % settings.min_length

    def rebuilt(value: Column, pattern: str, use) -> Column:
        parts = F.struct(F.split(value, pattern, -1).alias("gaps"),
                         F.regexp_extract_all(value, F.lit(pattern), F.lit(0)).alias("hits"))
        return F.when(value.rlike(pattern), let(parts, lambda p: F.array_join(F.transform(
            F.sequence(F.lit(1), F.size(p["gaps"])),
            lambda i: F.concat(F.when(i > 1, use(F.get(p["hits"], i - 2))).otherwise(F.lit("")), F.element_at(p["gaps"], i)),
        ), ""))).otherwise(value)

    def assignment(hit: Column) -> Column:
        value = F.regexp_extract(hit, ASSIGN, 2)
        return F.when(F.length(value) >= LEAST_VALUE,
                      F.concat(F.regexp_replace(hit, r"(?<=[:=\x20\"'])[A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]*\z", ""), F.lit(PLACEHOLDER))).otherwise(hit)

    first = rebuilt(text, ASSIGN, assignment)
    second = F.regexp_replace(first, f"{HEX}|{ACCESS}", PLACEHOLDER)
    return let(second, lambda t: rebuilt(
        t, token, lambda hit: F.when(_is_random(hit, model, settings), F.lit(PLACEHOLDER)).otherwise(hit)))
