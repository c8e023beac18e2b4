"""Personal data: base patterns and boosted candidates, on DataFrame functions and Spark's tree boosting.

Base spans follow the contract. Beside them, high-recall generators propose spans of looser forms (spelt-out
addresses, numbers without a country code, cards with other separators, IPv6) and of secrets (long keys and tokens,
a fifth kind). Boosted trees, fitted on templates below, judge each proposal by its form and context; a threshold,
set on held-out templates for a stated precision, selects which are added. Base spans always stay, proposals that
overlap one are dropped, and of proposals that overlap one another the one of the highest score is taken first.

The trees become one expression over a proposal's features, so a document is scored in place: nothing is
exploded, joined or shuffled, and no Python runs on the executors.

Defined results: a null text is an empty one; an empty text has no spans; rows that repeat are judged one by
one; positions count code points, ends are exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, unused

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the method adds.
ALL_KINDS = (*KINDS, "secret")
#: Base patterns of the contract, written so that Java neither recurses nor rescans; the leading conditions
#: only skip starts that can't match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, which propose.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[.\x20-]?[0-9]{4}){3}+(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]{0,40}+[0-9])[0-9A-Za-z_/+-]{20,200}+={0,2}+(?![0-9A-Za-z_/+-])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:00[0-9]{1,3}+[\x20.-])?+\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: What a text must have for a pattern to be tried: cheap to find.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = 32
#: Words before a span that speak for each kind, and against any.
SPEAKS_FOR = {"email": r"(?i)mail|contact|write to|reach", "ip": r"(?i)\bip\b|address|host|server", "card": r"(?i)card|visa|master|credit|payment", "phone": r"(?i)phone|call|tel\b|mobile|fax|dial", "secret": r"(?i)token|secret|passw|key\b|credential|auth|bearer"}
SPEAKS_AGAINST = r"(?i)version|build|order|invoice|isbn|serial|part|sku|release|ref|ticket|model|commit|digest|checksum|hash|sha[0-9]|md5|uuid|path|file"
#: Least precision on held-out templates at which a score adds spans; templates drawn; trees and their depth.
PRECISION, DRAWN, TREES, DEPTH = 0.98, 3000, 10, 3
#: Templates (fixed texts; # stands for a digit, ~ for a hexadecimal one, * for a letter): label and text.
TEMPLATES = [
    (1, "contact me by mail at *****.*** (at) ****** (dot) com today"), (1, "write to **** [at] *******.org please"), (1, "reach us: *****(at)****.net"),
    (1, "phone (###) ###-#### any time"), (1, "call ###-###-#### now"), (1, "tel 001 ### ### #### office"), (1, "my mobile ###.###.####"), (1, "fax: 0044 ### ### ####"),
    (1, "credit card 4###.####.####.#### on file"), (1, "visa 4###-####-####-#### expires"), (1, "payment by mastercard 5### #### #### ####"),
    (1, "server address ~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~ up"), (1, "ip ~~~~:~:~~~~:~~~:~~~~:~~:~~~~:~~~~"), (1, "host ~~~~:~~~~:~:~:~:~~~~:~~~~:~~~~"),
    (1, 'token = "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~" ** ***'), (1, "api_key: ~~~~#~~~~~~~~~~~~~~~~#~~~~~~~~~~ ***"), (1, "my password=**##**#*#**##**#*#**#* now"), (1, "secret '#**#*#*#**#*#*#**#*#**#*#**#*#**' in use"), (1, 'authorization: bearer **##***#**#***##**#***#**#**'), (1, 'access key AKIA#**##*#**##*#**# of an account'),
    (0, "commit ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~ on main"), (0, "sha256 digest ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~#~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"), (0, "checksum: ~~~~~~~~~~#~~~~~~~~~~~~~~~~~~~~~"), (0, "** *** **********************#** ***"), (0, "file path_to/********/**_**##/*********** here"), (0, "*** ** ########################## **"), (0, "*** *****-******-****-*****-## ***"),
    (0, "order ###-###-#### shipped"), (0, "part ###.###.#### in stock"), (0, "isbn ### ### #### second edition"), (0, "serial (###) ###-####"), (0, "invoice ####.####.####.#### of may"),
    (0, "ticket ####-####-####-#### closed"), (0, "sku #### #### #### #### blue"), (0, "** *** ################ *** **"), (0, "** **** ### ### #### ***** **"), (0, "release ~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~ hash"),
    (0, "the meeting ** (at) *****.** point"), (0, "model ***@##.## series"), (0, "build *** [at] ##.## branch"), (0, "**** ####-####-####-#### ****"), (0, "**** ###.###.#### ****"), (0, "version ** (at) ##.#"),
]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a number passes: every second digit from the right doubled, 9 taken off where over 9."""
    each = F.split(F.reverse(digits(value)), "")
    doubled = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(value)).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


SPAN = "struct<start:int,kind:int,end:int,value:string,before:string,after:string>"


def spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches with positions and what stands around them, up to the neighbouring matches."""
    none = F.array().cast(f"array<{SPAN}>")

    def placed(matches, gaps):
        pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        # each pair moves on by its gap and its match; the last gap has none, and its start isn't read
        walk = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, p: F.struct((s["at"] + F.length(p["g"]) + F.length(p["m"])).alias("at"), F.array_append(s["starts"], s["at"] + F.length(p["g"])).alias("starts")))
        return once(walk["starts"], lambda starts: F.transform(matches, lambda m, i: F.struct(
            F.get(starts, i).alias("start"), F.lit(ALL_KINDS.index(kind)).alias("kind"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("value"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")
        ).cast(SPAN)))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(once(F.split(text, pattern, -1), lambda g: placed(m, g))))


def features(c: Column) -> dict[str, Column]:
    """Form and context of a proposal."""
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    value, n = c["value"], F.length(digits(c["value"]))
    own = reduce(lambda rest, k: F.when(c["kind"] == ALL_KINDS.index(k), c["before"].rlike(SPEAKS_FOR[k])).otherwise(rest), ALL_KINDS, F.lit(False))
    return {
        **{f"is_{k}": flag(c["kind"] == i) for i, k in enumerate(ALL_KINDS)},
        "length": F.length(value).cast("double"),
        "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
        "assigned": flag(c["before"].rlike("[=:]\\s*[\"']?$")),
        "n_digits": n.cast("double"),
        "share_digits": n / F.length(value),
        "separators": (F.length(value) - F.length(F.regexp_replace(value, r"[\x20.()\[\]-]", ""))).cast("double"),
        "luhn": flag(F.when((c["kind"] == 2) & (n >= 12), luhn(value)).otherwise(False)),
        "issuer": flag(value.rlike("^[3-6]")),
        "spelt_out": flag(value.rlike(r"\(at\)|\[at\]|dot")),
        "top_label": flag(value.rlike(r"[.)\] ][A-Za-z]{2,}$")),
        "paren": flag(value.rlike(r"^(00[0-9]+.)?\(")),
        "speaks_for": flag(own),
        "speaks_against": flag(c["before"].rlike(SPEAKS_AGAINST)),
    }


def proposals(text: Column) -> Column:
    """Spans of the looser forms and secrets, where a text can have any."""
    digit = text.rlike("[0-9]")
    able = {"email": (F.instr(text, "@") > 0) | (F.instr(text, "(at)") > 0) | (F.instr(text, "[at]") > 0), "ip": F.instr(text, ":") > 0, "card": digit, "phone": digit, "secret": digit}
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*[F.when(able[k], spans(text, k, LOOSE[k])).otherwise(none) for k in ALL_KINDS])


def base(text: Column) -> Column:
    """The contract's spans, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")
    digit = text.rlike("[0-9]")
    passing = lambda k: F.filter(spans(text, k, BASE[k]), lambda c: valid(k, c["value"]))
    found = [F.when(F.instr(text, NEEDS[k]) > 0 if k in NEEDS else digit, passing(k)).otherwise(none) for k in KINDS]
    return F.array_sort(F.concat(*found))


def drawn_templates(spark: SparkSession) -> DataFrame:
    """Rows (id, label, text): templates with their places filled from hashes of the row's number."""
    ids = spark.range(0, DRAWN, 1, 1)
    t = F.get(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in TEMPLATES]), (F.col("id") % len(TEMPLATES)).cast("int"))

    def filled(c, i):
        h = F.pmod(F.xxhash64("id", i), F.lit(1 << 30))
        pick = lambda letters: F.substring(F.lit(letters), (h % len(letters) + 1).cast("int"), F.lit(1))
        return F.when(c == "#", pick("0123456789")).when(c == "~", pick("0123456789abcdef")).when(c == "*", pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)

    return ids.select("id", t["y"].alias("label"), F.array_join(F.transform(F.split(t["x"], ""), filled), "").alias("text"))


def tree_value(node, c: dict[str, Column], names: list[str]) -> Column:
    """A tree of the fitted model as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(c[names[split.featureIndex()]] <= float(split.threshold()), tree_value(node.leftChild(), c, names)).otherwise(tree_value(node.rightChild(), c, names))


class Judge:
    """Fitted trees with a threshold: chooses among proposals."""

    def __init__(self, spark: SparkSession):
        rows = drawn_templates(spark).select("id", "label", F.explode(proposals(F.col("text"))).alias("c"))
        rows = rows.select("id", "label", "c", F.struct(*[v.alias(k) for k, v in features(F.col("c")).items()]).alias("f")).select("id", F.col("label").cast("double").alias("label"), "f.*")
        self.names = [x for x in rows.columns if x not in ("id", "label")]
        rows = VectorAssembler(inputCols=self.names, outputCol="features").transform(rows).select("id", "label", "features").cache()
        held = F.col("id") % 97 % 4 == 0
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=1.0).fit(rows.filter(~held))
        self.trees = [(float(w), t.rootNode()) for w, t in zip(model.treeWeights, model._java_obj.trees())]
        # held-out templates, a few hundred rows: the least score whose precision from there up is as stated
        got = sorted(((float(r["rawPrediction"][1]), int(r["label"])) for r in model.transform(rows.filter(held)).select("rawPrediction", "label").collect()), reverse=True)
        rows.unpersist()
        self.threshold, right = float("inf"), 0
        for i, (score, y) in enumerate(got, 1):
            right += y
            if right >= PRECISION * i and (i == len(got) or got[i][0] < score):
                self.threshold = score

    def score(self, c: Column) -> Column:
        f = F.struct(*[v.alias(k) for k, v in features(c).items()])
        total = lambda x: reduce(lambda s, t: s + t, [F.lit(w) * tree_value(n, {k: x[k] for k in self.names}, self.names) for w, n in self.trees])
        return once(f, total)

    def chosen(self, proposed: Column) -> Column:
        """Of the proposals that pass, the surest first, none that overlaps one before it."""
        scored = F.transform(proposed, lambda c: F.struct((-self.score(c)).alias("s"), c.alias("c")))
        passing = F.array_sort(F.filter(scored, lambda x: -x["s"] >= self.threshold - 1e-9))
        none = F.array().cast(f"array<{SPAN}>")
        taken = F.aggregate(passing, none, lambda got, x: F.when(F.exists(got, lambda d: overlaps(d, x["c"])), got).otherwise(F.array_append(got, x["c"])))
        return F.when(F.size(proposed) == 0, none).otherwise(taken)


def overlaps(c: Column, d: Column) -> Column:
    return (c["start"] < d["end"]) & (d["start"] < c["end"])


def found(docs: DataFrame, text: str = "text", name: str | None = None) -> DataFrame:
    """Adds a struct: base and all, arrays of spans by start and kind; as `pii`, with underscores after it if there is such a column."""
    judge = Judge(docs.sparkSession)

    def judged(t):
        def with_base(b):
            free = F.filter(proposals(t), lambda c: ~F.exists(b, lambda d: overlaps(c, d)))
            added = once(free, judge.chosen)
            return F.struct(b.alias("base"), F.array_sort(F.concat(b, added)).alias("all"))

        return once(base(t), with_base)

    return docs.withColumn(name or unused(docs, "pii"), once(F.coalesce(docs[text].cast("string"), F.lit("")), judged))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with each span replaced by its kind in brackets; of spans that overlap, the later gives way."""
    names = F.array(*map(F.lit, ALL_KINDS))

    def cut(t):
        def rebuilt(s):
            step = lambda a, c: F.when(c["start"] < a["at"], a).otherwise(F.struct(c["end"].alias("at"), F.concat(a["out"], F.substr(t, a["at"] + 1, c["start"] - a["at"]), F.lit("["), F.get(names, c["kind"]), F.lit("]")).alias("out")))
            end = F.aggregate(s, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
            return once(end, lambda e: F.concat(e["out"], F.substr(t, e["at"] + 1)))

        return rebuilt

    name = unused(docs, "pii")
    out = found(docs, text, name)
    clean = F.when(F.col(text).isNull(), F.lit(None)).otherwise(once(F.col(text).cast("string"), lambda t: cut(t)(F.col(name)["all"])))
    return out.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
