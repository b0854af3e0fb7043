"""Personal data by weak supervision; texts and candidates see DataFrame functions only.

Candidates are regex hits: four strict kinds (email, ip, card, phone, each with
its own check) and looser forms of emails and phones. Four labelers vote on each
candidate: the strict rule, a gazetteer (top-level domains, card issuers, area
codes), the words before it, and its borders. They vote yes, no or abstain.

Expectation-maximisation over the counts of vote patterns estimates, for each
kind, how reliable every labeler is. The patterns' posteriors are then the soft
labels of a logistic span classifier. Both run until their parameters stop moving.
Only the table of patterns and their counts comes to the driver, once: it has at
most 96 rows (kinds and votes), however many the documents.

A strict hit is always a span. The classifier decides on the looser candidates,
and one that overlaps a strict span is dropped.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

KINDS = ["email", "ip", "card", "phone"]

#: Java forms of the strict patterns. They match what
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`` and the others match, leftmost and
#: without overlap, but a run of characters is tried once, from its start (or from
#: the end of the match before), instead of from each of its characters.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])",
}
#: Words that announce each kind, and top-level domains.
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|courriel|kontakt)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|address|server|host|adresse)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|credit|payment|tarjeta|carte|karte)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|tel\b|call|fax|mobile|cell|telefon)[^\n]{0,24}$",
}
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "us", "eu", "it", "nl", "ch", "at"]
VOTES = ["rule", "gazetteer", "context", "border"]
#: Parameters stand still when none moves by more than this in a round; no end is found beyond so many rounds.
STILL, MOST_ROUNDS = 1e-9, 100_000


def _hits(text: Column, pattern: str) -> Column:
    """Array of (gap, before, hit, after) in order: the text between two hits gives the positions."""
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(
        gaps.alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"),
    )
    return F.transform(
        F.filter(rows, lambda r: r["hit"].isNotNull()),
        lambda r: F.struct(
            F.length(r["gap"]).alias("gap"),
            F.right(r["gap"], F.lit(48)).alias("before"),
            r["hit"].alias("hit"),
            F.left(r["next"], F.lit(1)).alias("after"),
        ),
    )


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the check sum."""
    # Splitting between characters leaves an empty string at the end, which counts as zero.
    number = lambda d: F.coalesce(d.try_cast("int"), F.lit(0))
    doubled = F.transform(
        F.split(F.reverse(digits), "(?!^)"),
        lambda d, i: F.when(i % 2 == 0, number(d)).otherwise(number(d) * 2 - F.when(number(d) >= 5, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    count = F.length(digits)
    small = F.forall(
        F.split(hit, r"\."),
        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
        & (F.coalesce(F.left(F.regexp_replace(p, "^0+", ""), F.lit(3)).try_cast("int"), F.lit(0)) <= 255),
    )
    card = F.when(count.between(14, 19), _luhn(digits)).otherwise(False)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", card)
        .otherwise(count.between(10, 15))
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, kind, strict, start, end, hit, before, after) for each candidate.

    Positions count code points, the end is exclusive. ``_th`` is the text's hash,
    which keeps rows apart that repeat an id with another text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits, at = text.rlike("[0-9]"), text.contains("@")
    bracketed = text.rlike(r"[\[(](?:at|AT)[\])]")
    none = F.slice(_hits(text, STRICT["card"]), 1, 0)
    wanted = [
        (kind, True, F.when({"email": at, "ip": digits, "card": digits, "phone": digits & text.contains("+")}[kind], _hits(text, STRICT[kind])))
        for kind in KINDS
    ] + [("email", False, F.when(bracketed, _hits(text, LOOSE["email"]))), ("phone", False, F.when(digits, _hits(text, LOOSE["phone"])))]
    found = F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("strict"), h.alias("hits")) for k, s, h in wanted]),
        lambda x: F.size(x["hits"]) > 0,
    )
    rows = (
        docs.where(digits | at | bracketed)
        .select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.explode(found).alias("f"))
        .select("_id", "_th", "f.kind", "f.strict", F.posexplode("f.hits").alias("pos", "h"))
        .dropDuplicates(["_id", "_th", "kind", "strict", "pos"])
    )
    order = Window.partitionBy("_id", "_th", "kind", "strict").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("h.hit")
    end = F.sum(F.col("h.gap") + length).over(order)
    return (
        rows.select("*", end.alias("end"), length.alias("len"))
        .select("_id", "_th", "kind", "strict", (F.col("end") - F.col("len")).alias("start"), "end", "h.hit", "h.before", "h.after")
        .where(~F.col("strict") | _passes(F.col("kind"), F.col("hit")))
    )


def _votes(found: DataFrame) -> DataFrame:
    """Votes of the labelers: 1 yes, 0 no, null abstains."""
    kind, hit = F.col("kind"), F.col("hit")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    known = (
        F.when(kind == "email", F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(DOMAINS))
        .when(kind == "ip", ~digits.rlike("^0") & ~hit.rlike(r"^(?:0|127|2[2-5][0-9])\."))
        .when(kind == "card", digits.rlike("^(?:4|5[1-5]|3[47]|6011|65|2[2-7])"))
        .otherwise(F.right(digits, F.lit(10)).rlike("^[2-9]"))
    )
    cue = F.coalesce(*[F.when(kind == k, F.col("before").rlike(p)) for k, p in CUES.items()])
    open_side = F.length("before").eqNullSafe(0) | F.col("before").rlike(r"[^A-Za-z0-9]$")
    bordered = open_side & ~F.coalesce(F.col("after"), F.lit("")).rlike("^[A-Za-z0-9]")
    return found.select(
        "*",
        F.when(F.col("strict"), 1).otherwise(0).alias("rule"),
        F.when(known, 1).otherwise(0).alias("gazetteer"),
        F.when(cue, 1).alias("context"),
        F.when(bordered, 1).otherwise(0).alias("border"),
    )


def _odds(model: dict, row: dict) -> float:
    """The log odds that a candidate with these votes is a true span.

    ``model`` has the share of true spans, and for each labeler the chance of a yes
    on a true (_t) and on a false (_f) span.
    """
    total = math.log(model["share"] / (1 - model["share"]))
    for v in VOTES:
        if row[v] is not None:
            t, f = model[f"{v}_t"], model[f"{v}_f"]
            total += math.log(t / f) if row[v] == 1 else math.log((1 - t) / (1 - f))
    return total


def _chance(odds: float) -> float:
    """The logistic function, without overflow."""
    return 1 / (1 + math.exp(-odds)) if odds >= 0 else math.exp(odds) / (1 + math.exp(odds))


def _round(model: dict, rows: list[dict]) -> dict:
    """One round of expectation-maximisation over one kind's patterns.

    Counts are smoothed by a weak prior, which says that labelers are better than chance.
    """
    weighed = [(r, r["n"] * (q := _chance(_odds(model, r))), r["n"] * (1 - q)) for r in rows]
    true, false = (math.fsum(w[i] for w in weighed) for i in (1, 2))
    made = {"share": (true + 7) / (true + false + 10)}
    for v in VOTES:
        for name, i, prior in (("t", 1, 8), ("f", 2, 3)):
            voted = math.fsum(w[i] for w in weighed if w[0][v] is not None)
            made[f"{v}_{name}"] = (math.fsum(w[i] for w in weighed if w[0][v] == 1) + prior) / (voted + 10)
    return made


def _reliabilities(patterns: list[dict], rounds: int) -> dict[str, dict]:
    """Each kind's parameters by expectation-maximisation over vote patterns with counts ``n``.

    At least ``rounds`` rounds, and then until no parameter moves by more than ``STILL``.
    """
    found = {}
    for kind in KINDS:
        rows = [r for r in patterns if r["kind"] == kind]
        now = {"share": 0.7} | {f"{v}_t": 0.8 for v in VOTES} | {f"{v}_f": 0.3 for v in VOTES}
        for done in range(1, MOST_ROUNDS + 1):
            then, now = now, _round(now, rows)
            if done >= rounds and max(abs(now[k] - then[k]) for k in now) <= STILL:
                break
        else:
            raise ArithmeticError(f"the reliabilities of {kind} still move after {MOST_ROUNDS} rounds")
        found[kind] = now
    return found


def _features() -> list[Column]:
    """Inputs of the span classifier: a constant for each kind, and each vote as -1, 0 or 1."""
    kinds = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in KINDS]
    return kinds + [F.coalesce(F.when(F.col(v) == 1, 1.0).when(F.col(v) == 0, -1.0), F.lit(0.0)) for v in VOTES]


def _linear(weights: list[float]) -> Column:
    total = F.lit(0.0)
    for w, x in zip(weights, _features(), strict=True):
        total = total + F.lit(float(w)) * x
    return 1 / (1 + F.exp(-total))


def _train(patterns: list[dict], q: list[float], steps: int) -> list[float]:
    """Logistic regression on soft labels ``q`` with counts ``n``.

    At least ``steps`` steps of Newton's method, halved while the loss grows, and then
    until no weight moves by more than ``STILL``. Where inputs say the same, the
    shortest of the equal solutions is taken.
    """
    x = np.array([[float(r["kind"] == k) for k in KINDS] + [{1: 1.0, 0: -1.0}.get(r[v], 0.0) for v in VOTES] for r in patterns])
    weights = np.zeros(len(KINDS) + len(VOTES))
    if not len(patterns):
        return weights.tolist()
    n, q = np.array([float(r["n"]) for r in patterns]), np.array(q)
    n /= n.sum()
    loss = lambda w: float((n * (np.logaddexp(0, x @ w) - q * (x @ w))).sum())
    for done in range(1, MOST_ROUNDS + 1):
        p = np.exp(-np.logaddexp(0, -(x @ weights)))
        move = np.linalg.lstsq((x.T * (n * p * (1 - p))) @ x, x.T @ (n * (q - p)), rcond=1e-12)[0]
        before = loss(weights)
        while loss(weights + move) > before and np.abs(move).max() > STILL:
            move /= 2
        weights = weights + move
        if done >= steps and np.abs(move).max() <= STILL:
            return weights.tolist()
    raise ArithmeticError(f"the span classifier's weights still move after {MOST_ROUNDS} steps")


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", em_rounds: int = 6, train_steps: int = 8, threshold: float = 0.5
) -> DataFrame:
    """Spans of personal data: (_id, _th, kind, start, end, hit, strict, score).

    Null texts count as empty and have no spans. Several kinds may overlap. Rows
    that repeat both id and text give their spans once; a null id is an id. Columns of ``docs`` other
    than the two named are not read. No candidates at all give an empty result.
    ``em_rounds`` and ``train_steps`` are the fewest; both go on until nothing moves.
    """
    found = stored(_votes(candidates(docs, id_col, text_col)), "pii")
    # One small table, in one order, whatever the documents: 4 kinds, and two or three votes of each labeler.
    patterns = [r.asDict() for r in found.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).orderBy("kind", *VOTES).collect()]
    model = _reliabilities(patterns, em_rounds)
    weights = _train(patterns, [_chance(_odds(model[r["kind"]], r)) for r in patterns], train_steps)
    scored = found.withColumn("score", _linear(weights)).where(F.col("strict") | (F.col("score") >= threshold))
    # A looser span goes if a strict one overlaps it: ends before it and starts after it tell.
    # Both look back, in either order, since a frame that looks ahead is summed anew for every row.
    doc = Window.partitionBy("_id", "_th")
    forth, back = (doc.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (["start", "end"], [F.desc("start"), F.desc("end")]))
    before = F.max(F.when(F.col("strict"), F.col("end"))).over(forth)
    after = F.min(F.when(F.col("strict"), F.col("start"))).over(back)
    clear = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return (
        scored.withColumn("clear", clear)
        .where(F.col("strict") | F.col("clear"))
        .select("_id", "_th", "kind", "start", "end", "hit", "strict", "score")
    )


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: strict spans counted and digested, all spans listed.

    Returns (id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_base, n_spans);
    the last two count the strict spans and all. A row without spans has zero
    counts, the digest of the empty string and ''.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    spans = find_pii(docs, id_col, text_col)
    label = F.concat_ws(":", "kind", "start", "end")
    per_doc = spans.groupBy("_id", "_th").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", label.alias("label"), "strict"))).alias("all"),
        *[F.count(F.when((F.col("kind") == k) & F.col("strict"), 1)).alias(f"n_{k}") for k in KINDS],
    )
    strict = F.filter("all", lambda s: s["strict"])
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: s["label"]))
    per_doc = per_doc.select("_id", "_th", *[f"n_{k}" for k in KINDS], joined(strict).alias("base"), joined(F.col("all")).alias("spans"), F.size(strict).alias("n_base"), F.size("all").alias("n_spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_row"), F.xxhash64(text).alias("_text"))
    same = F.col("_row").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_th"))
    return rows.join(per_doc, same, "left").select(
        F.col("_row").alias(id_col),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_base", "n_spans")],
    )
