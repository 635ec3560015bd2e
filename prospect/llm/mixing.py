"""Mixing to target weights with soft memberships (operator 10, native).

1. *Cells.*  Every document falls into a cell of categorical features: source
   tag, language, and logarithmic buckets of its word count, its share of
   capitals and its share of symbols, all taken from the whole text.  Cells are
   counted with their documents and tokens (words) in one aggregation.
2. *Classifier.*  The labelled table gives the domain of some documents.  A
   naive Bayes classifier over the cell features (add-one smoothing) predicts
   the posterior of every domain for every cell: documents are members of
   several domains at once.
3. *Rates.*  Nonnegative rates ``r`` (copies per document) minimise the squared
   error between expected domain tokens ``sum r t p`` and the targets, relative
   to each domain's present share, by projected gradient from ``r = 1``.  Equal
   posteriors have equal gradients, so the rate of a document is the rate of
   its cell, and each step is one distributed sum over (cell, domain) rows.  A
   step's only traffic is one number per domain; after every ``KEPT`` steps the
   rates are written, so plans stay short however many steps follow.
4. *Draw.*  A document is repeated ``floor(rate + u)`` times, ``u`` being a
   uniform hash of its id, so expected tokens follow the rates.

The number of cells depends on the kinds of features, not on the documents.
Domains are rows of a table in an order of their own; their number has no cap,
and the work grows as cells times domains, as soft memberships do.

Edge cases: NULL source or language is a value of its own; NULL or empty texts
have no tokens (their rate follows their cell and they weigh nothing); a
NULL id draws by its text; repeated rows draw alike; an empty table gives no
rows; with no labelled document every posterior is equal; domains that are only
in the targets get no documents and are left out; any column names of the input
pass through unchanged in ``mix``; very long texts are read whole, once, into five
features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospect.llm.common import SPACE_CLASS, fresh_names, let, small_side
from prospect.session import materialize, materialize_counted

FEATURES = ("f_source", "f_lang", "f_words", "f_upper", "f_symbol")
STEPS = 30
#: Steps end once every domain is within this part of its present share.
TOLERANCE = 1e-3
#: Default targets: present shares to this power, so small domains gain.
TEMPERATURE = 0.5
#: Steps whose gradients a plan carries before the rates are written.
KEPT = 5


def numbers(values: list[float]) -> Column:
    """An array<double> constant as one literal, whatever its length."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>") if values else F.array().cast("array<double>")


def _share_bucket(part: Column, whole: Column) -> Column:
    return F.least(F.lit(9), F.floor(-F.log2((part + 0.5) / (whole + 1.0)))).cast("int")


def features(text: Column, source: Column, lang: Column) -> dict[str, Column]:
    """Cell features and token count of a document, as columns."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.size(F.filter(F.split(t, SPACE_CLASS), lambda w: w != "")).cast("long")
    chars = F.length(t)
    upper = chars - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))
    symbol = chars - F.length(F.regexp_replace(t, "[#$%&*|!]+", ""))
    return {
        "f_source": F.coalesce(source.cast("string"), F.lit("")),
        "f_lang": F.coalesce(lang.cast("string"), F.lit("")),
        "f_words": F.floor(F.log2(tokens + 1.0)).cast("int").cast("string"),
        "f_upper": _share_bucket(upper, chars).cast("string"),
        "f_symbol": _share_bucket(symbol, chars).cast("string"),
        "tokens": tokens,
    }


def cells_of(docs: DataFrame) -> DataFrame:
    """(doc_id, draw, features, tokens) of every row."""
    f = features(F.col("text"), F.col("source"), F.col("lang"))
    return docs.select(F.col("doc_id"), draw_column(F.col("doc_id"), F.col("text")).alias("draw"), *[c.alias(k) for k, c in f.items()])


def draw_column(doc_id: Column, text: Column) -> Column:
    """Uniform number in [0, 1) from the id (NULL: from the text)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def posteriors(cells: DataFrame, labelled: DataFrame) -> tuple[list[str], DataFrame]:
    """Domains in order and (features, tokens, docs, p array) per cell.

    ``cells``: features with ``tokens`` and ``docs``; ``labelled``: features
    with ``domain``.  The counts of the classifier are one aggregation each; the
    domains and their counts come to the driver, one number each."""
    counts = materialize(labelled.groupBy("domain", *FEATURES).agg(F.count(F.lit(1)).alias("c")), "mix-counts")
    prior = [(r[0], float(r[1])) for r in counts.groupBy("domain").agg(F.sum("c")).orderBy("domain").collect()]
    domains, held = [d for d, _ in prior], [c for _, c in prior]
    if not domains:
        return [], cells.withColumn("p", F.array().cast("array<double>"))
    names = counts.select("domain").distinct().withColumn("place", F.row_number().over(Window.orderBy("domain")) - 1)
    counts = materialize(counts.join(names, "domain"), "mix-placed")
    scored = cells.withColumn("logp", F.transform(numbers(held), lambda c: F.log(c / F.lit(sum(held)))))
    for f in FEATURES:
        values = materialize(counts.groupBy(f, "place").agg(F.sum("c").cast("double").alias("c")), "mix-values")
        kinds = values.select(f).distinct().count() + 1
        # One row per feature value: its smoothed likelihood in every domain.
        by = values.groupBy(f).agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("by"))
        seen = _filled("by", len(domains))
        likely = by.select(f, F.zip_with(seen, numbers(held), lambda s, c: F.log((s + 1.0) / (c + kinds))).alias("likely"))
        unseen = F.transform(numbers(held), lambda c: F.log(F.lit(1.0) / (c + kinds)))
        scored = scored.join(likely, f, "left").withColumn(
            "logp", F.zip_with("logp", F.coalesce("likely", unseen), lambda a, b: a + b)).drop("likely")
    return domains, scored.withColumn("p", _softmax(F.col("logp"))).drop("logp")


def _softmax(logs: Column) -> Column:
    """Shares in proportion to ``exp``; maximum and sum are taken once a row."""
    def raised(v: Column) -> Column:
        return let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))

    def shared(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))

    return let(let(logs, raised), shared)


def _filled(entries: str, size: int) -> Column:
    """(place, c) entries in order as an array of ``size`` counts, zeros between."""
    def after(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(entries, i)["place"]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0.0), x["place"] - before - 1), F.array(x["c"]))

    rest = F.array_repeat(F.lit(0.0), F.lit(size - 1) - F.element_at(entries, -1)["place"])
    return F.concat(F.flatten(F.transform(entries, after)), rest)


def _dot(p: str, g: Column) -> Column:
    return F.aggregate(F.zip_with(F.col(p), g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def _rate(past: list[list[float]]) -> Column:
    """``rate`` after the given gradients: one projected step for each."""
    rate = F.col("rate")
    for g in past:
        rate = F.greatest(F.lit(0.0), rate - _dot("p", numbers(g)))
    return rate


def fit_rates(cells: DataFrame, domains: list[str], targets: dict[str, float] | None, steps: int = STEPS) -> DataFrame:
    """(features, p, rate) of the cells.  ``targets``: weights by domain
    (default: present shares tempered); they are scaled to the present tokens."""
    state = cells.select(*FEATURES, "p", "tokens", F.lit(1.0).alias("rate"))
    n = len(domains)
    if not n:
        return state.drop("tokens")

    def sums(rate: Column) -> list[float]:
        # The mass is taken once a cell, before its domains become rows.
        parts = let(F.col("tokens") * rate, lambda mass: F.transform("p", lambda x: mass * x))
        mass = state.select(F.posexplode(parts).alias("place", "part"))
        by = {r[0]: float(r[1]) for r in mass.groupBy("place").agg(F.sum("part")).collect()}  # one number a domain
        return [by.get(k, 0.0) for k in range(n)]

    present = sums(F.col("rate"))
    total = sum(present)
    if total <= 0:
        return state.drop("tokens")
    share = [x / total for x in present]
    wanted = [s ** TEMPERATURE for s in share] if targets is None else [max(0.0, float(targets.get(d, 0.0))) for d in domains]
    if sum(wanted) <= 0:
        raise ValueError("targets need a positive weight for some domain")
    goal = [w / sum(wanted) for w in wanted]
    past: list[list[float]] = []
    now = share
    for _ in range(steps):
        step = [(s - g) / m if m > 0 else 0.0 for s, g, m in zip(now, goal, share)]
        if max(abs(x) for x in step) < TOLERANCE:
            break
        past.append(step)
        if len(past) == KEPT:
            state = materialize(state.withColumn("rate", _rate(past)), "mix-state")
            past = []
        now = [x / total for x in sums(_rate(past))]
    return state.withColumn("rate", _rate(past)).drop("tokens")


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(rows with features, cells with rate, number of cells).

    ``labelled``: (doc_id, domain)."""
    rows = materialize(cells_of(docs), "mix-rows")
    cells = materialize(rows.groupBy(*FEATURES).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-cells")
    known = labelled.select("doc_id", "domain").dropna().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    domains, scored = posteriors(cells, rows.select("doc_id", *FEATURES).join(known, "doc_id"))
    scored = materialize(scored, "mix-posteriors")
    rated, n = materialize_counted(fit_rates(scored, domains, targets), "mix-rates")
    return rows, rated, n


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, rate, copies) of every row."""
    rows, rated, n = document_rates(docs, labelled, targets)
    cell = small_side(rated.select(*FEATURES, "rate"), n, 160)
    return rows.join(cell, list(FEATURES)).select(
        "doc_id", "tokens", "rate", F.floor(F.col("rate") + F.col("draw")).cast("int").alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every row repeated (or left out) by its rate."""
    _, rated, n = document_rates(docs, labelled, targets)
    f = features(docs["text"], docs["source"], docs["lang"])
    *own, rate, draw, copy = fresh_names(docs, *(f"mix_{k}" for k in FEATURES), "mix_rate", "mix_draw", "mix_copy")
    cell = rated.select(*[F.col(k).alias(o) for k, o in zip(FEATURES, own)], F.col("rate").alias(rate))
    cols = docs.columns
    dealt = docs.withColumns({**{o: f[k] for k, o in zip(FEATURES, own)}, draw: draw_column(docs["doc_id"], docs["text"])}).join(small_side(cell, n, 160), own)
    copies = F.floor(F.col(rate) + F.col(draw)).cast("int")
    # Rows left out go before the rest is repeated.
    return dealt.filter(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*(F.col(f"`{c}`") for c in cols))


def source_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled table of the queries: the source of every labelled document."""
    known = labels.select("doc_id").dropna().distinct()
    return docs.select("doc_id", F.col("source").alias("domain")).join(known, "doc_id", "left_semi")
