"""Secret scan: fixed patterns, and character Markov models for what they miss.

Everything on the main path is DataFrame expressions. Spans are code point
offsets, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let as _let
from .shared import scan as _scan

#: The base kinds, as (kind, pattern, group to measure, least length of it).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Runs of these characters, so long, are judged by the Markov models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
#: Characters of a run that are judged at a time; longer runs are judged in parts of so many.
MOST = 1 << 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,%d}" % (LEAST, MOST)
#: Mean log-likelihood ratio for each character pair (nats) from which a run counts as random.
RATIO = 0.6
#: Fall of a stretch's sum (nats) that ends it: half of what LEAST characters must reach.
DROP = RATIO * LEAST / 2

#: Words that ordinary identifiers of the labelled samples are built of.
IDENTIFIER_WORDS = """
account action active address after array async avatar backup balance base batch before binary block body buffer build
button cache call cell change channel check child class clean click client clone close code collection color column
command comment commit common config connection const container content context control convert copy core count create
current cursor customer data database date debug default delete delta detail device dialog directory disable display
document domain double download draft drive driver edit element email empty enable encode engine entity entry error
event example execute export factory field file filter final find first fixed flag folder format frame function
generate global graph group handler header height helper history host icon image import index info init input insert
instance integer internal invoice item iterator join key label language last layout length level library limit line link
list load local location lock log login main manager map mapping margin master match matrix max memory menu merge message
method metric middle min mode model module month name native network next node normal note notify null number object
offset open option order output owner package page panel parameter parent parse partition path pattern payment point
policy pool position post prefix previous price print private process product profile project property provider proxy
public query queue random range rate reader record recursive redirect reference refresh region register release remote
remove render report request reset resource response result retry return right role root route row rule runtime sample
save schedule schema scope screen script search section select send sequence server service session setting share shift
show signal simple size sort source space stack start state static status step storage store stream string style submit
summary support switch symbol sync system table tag target task template temp test text thread time title toggle
total trace track transaction transform tree trigger type union unique unit update upload user utility validate value
variable vector version view visible visitor volume warning watch week width window worker wrapper write writer year zone
""".split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``(token, label)``: random strings (1) and ordinary identifiers (0), the same every time.

    Random strings are digests in base64, in its URL form, in hexadecimal and in
    upper-case letters and digits. Identifiers join two to five of the fixed words
    in camel, snake, kebab, path and upper-case style, some with a number at the end;
    rulers, runs of one character, are ordinary too.
    """
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    ids = spark.range(n).withColumn("d", F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    b64 = F.base64("d")
    hexed = F.lower(F.hex("d"))
    style = F.col("id") % 4
    strings = ids.select(
        F.when(style == 0, F.substring(b64, 1, 40))
        .when(style == 1, F.substring(F.translate(b64, "+/", "-_"), 1, 36))
        .when(style == 2, F.substring(hexed, 1, 40))
        .otherwise(F.substring(F.upper(F.translate(b64, "+/=", "")), 1, 32))
        .alias("token"),
        F.lit(1).alias("label"),
    )
    pick = F.transform(F.sequence(F.lit(1), (F.col("id") % 4 + 2).cast("int")), lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", i), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int")))
    named = ids.withColumn("w", pick)
    style = F.pmod(F.xxhash64("id"), F.lit(6))
    camel = F.concat(F.element_at("w", 1), F.array_join(F.transform(F.slice("w", 2, 9), lambda x: F.initcap(x)), ""))
    tail = F.when(F.col("id") % 5 == 0, (F.col("id") % 100).cast("string")).otherwise("")
    names = named.select(
        F.concat(
            F.when(style == 0, camel)
            .when(style == 1, F.array_join("w", "_"))
            .when(style == 2, F.array_join("w", "-"))
            .when(style == 3, F.array_join("w", "/"))
            .when(style == 4, F.upper(F.array_join("w", "_")))
            .otherwise(F.array_join("w", "")),
            tail,
        ).alias("token"),
        F.lit(0).alias("label"),
    )
    sign = F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1))
    rulers = spark.range(4 * len(ALPHABET)).select(F.repeat(sign, F.lit(40)).alias("token"), F.lit(0).alias("label"))
    return strings.union(names).union(rulers)


def train(samples: DataFrame, token_col: str = "token", label_col: str = "label", smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each character pair, random strings against identifiers.

    Two first-order Markov models over ALPHABET, from labelled rows; null tokens and
    labels are skipped. Entry ``i * n + j`` is for character j after i. The counts are
    aggregated before they come to the driver: ``2 * n * n`` rows at most, n = 67.
    """
    import numpy as np

    n = len(ALPHABET)
    token = F.col(token_col)
    pairs = samples.where(F.length(token) > 1).select(F.col(label_col).cast("int").alias("y"), F.explode(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, 2))).alias("p"))
    counted = pairs.groupBy("y", "p").count().collect()
    seen = np.full((2, n, n), smoothing)
    for row in counted:
        a, b = ALPHABET.find(row.p[0]), ALPHABET.find(row.p[1:])
        if row.y in (0, 1) and a >= 0 and b >= 0:
            seen[row.y, a, b] += row["count"]
    logs = np.log(seen / seen.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).ravel().tolist()


def _pair_ratios(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of each pair of neighbouring characters, as an array."""
    n, table = len(ALPHABET), F.expr(f"array({', '.join(f'{x!r}D' for x in model)})")
    places = F.transform(F.split(token, "", F.length(token)), lambda c: F.instr(F.lit(ALPHABET), c))
    pair = lambda a, b: F.coalesce(F.get(table, ((a - 1) * n + b - 1).cast("int")), F.lit(0.0))
    return _let(places, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), pair))


def _mean(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the token's character pairs; null for tokens of under two characters."""
    return F.when(F.length(token) > 1, _let(_pair_ratios(token, model), _mean))


def _stretches(pairs: Column, least_ratio: float) -> Column:
    """Array of (a, b): from character a to before b, the stretches that score best, from left to right.

    A stretch has LEAST characters at least and a mean of ``least_ratio`` or more. Two
    running sums of what pairs exceed that by, one LEAST - 1 pairs behind the other,
    give the best start for every end; a stretch is closed where its sum has fallen
    by DROP from its best, and the search goes on behind that best end.
    """
    far = LEAST - 1
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    real, whole = lambda x: F.lit(x).cast("double"), lambda x: F.lit(x).cast("int")
    # p, q: the two sums; low, at: the least q from ``base`` on and its place; best, a, b: the stretch so far.
    start = F.struct(*[real(0.0).alias(c) for c in "pq"], real(float("inf")).alias("low"), real(-1.0).alias("best"), *[whole(0).alias(c) for c in ("at", "base", "a", "b")], none.alias("out"))

    def closed(s):
        return F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))

    def over(w):
        def step(s, j):
            p = s["p"] + F.get(w, j) - least_ratio
            q = s["q"] + F.when(j >= far, F.get(w, j - far) - least_ratio).otherwise(0.0)
            return _let(F.struct(p.alias("p"), q.alias("q"), (j + 1 - far).alias("i"), j.alias("j"), s.alias("s")), placed)

        def placed(e):
            s = e["s"]
            lower = (e["i"] >= s["base"]) & (e["q"] < s["low"])
            low, at = F.when(lower, e["q"]).otherwise(s["low"]), F.when(lower, e["i"]).otherwise(s["at"])
            return _let(F.struct(e["p"].alias("p"), e["q"].alias("q"), low.alias("low"), at.alias("at"), (e["p"] - low).alias("sum"), e["j"].alias("j"), s.alias("s")), judged)

        def judged(e):
            s = e["s"]
            kept = [e["p"].alias("p"), e["q"].alias("q")]
            better = (e["sum"] >= 0) & (e["sum"] > s["best"])
            fallen = (s["best"] >= 0) & (e["sum"] < s["best"] - DROP)
            return (
                F.when(better, F.struct(*kept, e["low"].alias("low"), e["sum"].alias("best"), e["at"].alias("at"), s["base"].alias("base"), e["at"].alias("a"), (e["j"] + 2).alias("b"), s["out"].alias("out")))
                .when(fallen, F.struct(*kept, real(float("inf")).alias("low"), real(-1.0).alias("best"), whole(0).alias("at"), s["b"].alias("base"), whole(0).alias("a"), whole(0).alias("b"), closed(s).alias("out")))
                .otherwise(F.struct(*kept, e["low"].alias("low"), s["best"].alias("best"), e["at"].alias("at"), s["base"].alias("base"), s["a"].alias("a"), s["b"].alias("b"), s["out"].alias("out")))
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), start, step, lambda s: F.when(s["best"] >= 0, closed(s)).otherwise(s["out"]))

    return _let(pairs, over)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, match) of all matches, from left to right; empty where there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,match:string>>)")
    pieces = F.split(text, pattern, -1)

    def step(acc, x):
        a = acc["state"] + F.length(x["piece"])
        b = a + F.length(x["match"])
        return F.struct(b.alias("state"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))).alias("out"))

    # The last piece has no match after it; zipping cuts it off by the shorter array.
    zipped = _let(found, lambda f: F.zip_with(f, F.slice(pieces, 1, F.size(f)), lambda m, p: F.struct(m.alias("match"), p.alias("piece"))))
    return F.when(text.rlike(pattern), _scan(zipped, F.lit(0), none, step)["out"]).otherwise(none)


def _long_enough(pattern: str, group: int, least: int):
    return lambda s: F.length(F.regexp_extract(s["match"], pattern, group) if group else s["match"]) >= least


def _without(runs: Column, base: Column) -> Column:
    """What base spans leave of runs: an array of (start, end, kind, match), LEAST characters or more each.

    Runs and base spans are gone through together by their start. The state is the end
    of the base spans so far and the run at hand, whose rest begins at ``at``.
    """
    span = "struct<start:int,end:int,kind:string,match:string>"
    none = F.expr(f"cast(array() as array<{span}>)")
    tagged = lambda own: lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("s"))
    part = lambda run, a, b: F.struct(a.alias("start"), b.alias("end"), run["kind"].alias("kind"), F.substr(run["match"], a - run["start"] + 1, b - a).alias("match"))
    state = F.struct(F.lit(0).alias("over"), F.lit(0).alias("at"), F.lit(None).cast(span).alias("run"))

    def rest(s, to):
        """What is left of the state's run up to a place, if it is long enough."""
        return F.when(s["run"].isNotNull() & (to - s["at"] >= LEAST), F.array(part(s["run"], s["at"], to))).otherwise(none)

    def step(acc, x):
        s = acc["state"]
        run, base_ = x["s"], x["s"]
        before = F.when(s["run"].isNotNull(), F.when(x["own"] == 1, s["run"]["end"]).otherwise(F.least(s["run"]["end"], base_["start"])))
        next_run = F.struct(s["over"].alias("over"), F.greatest(run["start"], s["over"]).alias("at"), run.alias("run"))
        next_base = F.struct(F.greatest(s["over"], base_["end"]).alias("over"), F.greatest(s["at"], base_["end"]).alias("at"), s["run"].alias("run"))
        return F.struct(F.when(x["own"] == 1, next_run).otherwise(next_base).alias("state"), F.concat(acc["out"], rest(s, before)).alias("out"))

    both = F.array_sort(F.concat(F.transform(base, tagged(0)), F.transform(runs, tagged(1))))
    cut = _let(_scan(both, state, none, step), lambda r: F.concat(r["out"], rest(r["state"], r["state"]["run"]["end"])))
    return F.when(F.size(base) == 0, runs).otherwise(cut)


def _random(run: Column, model: list[float], least_ratio: float) -> Column:
    """The run where its mean is high enough, else its stretches that are: an array of (start, end, kind, match)."""
    piece = lambda s: F.struct((run["start"] + s["a"]).alias("start"), (run["start"] + s["b"]).alias("end"), run["kind"].alias("kind"), F.substr(run["match"], s["a"] + 1, s["b"] - s["a"]).alias("match"))
    return _let(_pair_ratios(run["match"], model), lambda w: F.when(_mean(w) >= least_ratio, F.array(run)).otherwise(F.transform(_stretches(w, least_ratio), piece)))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", least_ratio: float = RATIO) -> DataFrame:
    """``(doc_id, base, added)``: arrays of ``(start, end, kind, match)`` of every row's whole text.

    ``base``: by start, then kind as BASE lists them. ``added``: of kind
    ``markov``, what base spans leave of runs, where the models call it random: whole,
    or the best stretches of LEAST characters or more. Runs of over MOST characters are
    judged in parts of MOST. Null and empty texts have no spans; null ids and repeated
    rows are kept; other columns are not read. Work is one row at a time, in time near
    linear in the text's length, with no exchange.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    kinds = []
    for kind, pattern, group, least in BASE:
        spans = _spans(F.col("_t"), pattern, kind)
        kinds.append(F.filter(spans, _long_enough(pattern, group, least)))
    order = {kind: i for i, (kind, *_) in enumerate(BASE)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    keyed = F.transform(F.concat(*kinds), lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))
    rows = rows.withColumn("_b", F.array_sort(keyed))
    rows = rows.withColumn("base", F.transform("_b", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"))))
    rows = rows.withColumn("_runs", _without(_spans(F.col("_t"), CANDIDATE, "markov"), F.col("base")))
    runs = F.flatten(F.transform("_runs", lambda r: _random(r, model, least_ratio)))
    return rows.select("doc_id", "base", runs.alias("added"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
