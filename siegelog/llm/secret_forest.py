"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions and MLlib only.

A candidate is the value a name with a keyword is given (six or more printable characters,
in quotes or up to white space), the password in a URL, a token with dots, or a run of 16 or more characters of
which one is a digit. The forest sees its length, the transitions between its kinds of characters, how much of it a
dictionary covers, the path it was found under and the neighbouring words. It is trained
from labelled findings: a column ``label`` of 1 (secret), 0 (none) or null, of which
a bounded sample is taken, the first ``TRAIN_ROWS`` of each label in the order of a hash.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siegelog.llm.pseudonyms import digits_of, luhn_sum
from siegelog.llm.storage import stored

TRAIN_ROWS = 4000
DICTIONARY_WORDS = 200
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5

BEFORE, AFTER = 60, 30
# Words that name a secret: the long ones anywhere in a name, the short ones as a part of it (api_key, apiKey).
_PART = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
_NAME = rf"(?i:password|passwd|passphrase|pwd|secret|token|credential|api_?key)|{_PART}(?i:pass|api|key|auth|authorization|bearer)(?:(?i:s)?(?![A-Za-z])|(?=[A-Z]))"
KEYWORDS = rf"(?=[PSTCAKBpstcakb])(?:{_NAME})"
# A name with one of them and = or :, in any quotes, up to where its value begins.
_GIVEN = r"[A-Za-z0-9_.-]{0,20}[\"'`]?\]?\s{0,3}(?:=>|:=|[=:])\s{0,3}(?:(?i:bearer|basic|token)\s{1,3})?"
# The user in a URL, up to where the password begins.
_LOGIN = r"://[^\s/:@]{0,40}:"
ASSIGNED = rf"(?:{KEYWORDS}{_GIVEN}|\b(?i:bearer)\s{{1,3}})[\"'`]?$|{_LOGIN}$"
# The value of such a name. Short looks back come first: they rule most places out.
_VALUE_OF = rf"(?<=[=:>]\s{{0,3}}{{Q}}|(?i:bearer|basic|token)\s{{1,3}}{{Q}})(?<=(?:{KEYWORDS}{_GIVEN}|\b(?i:bearer)\s{{1,3}}){{Q}})"
_VALUES = [
    *(_VALUE_OF.replace("{Q}", q) + rf"[^{q}\p{{Cntrl}}]{{6,}}+(?={q})" for q in "\"'`"),
    rf"(?<=:)(?<={_LOGIN})[^\s/@]{{3,}}+(?=@)",
    _VALUE_OF.replace("{Q}", "[\"'`]?") + r"(?!(?i:bearer|basic|token)\s)[^\s\p{Cntrl}\"'`][^\s\p{Cntrl}]{5,}(?<![,;)\]}\"'`])",
]
# A run is entered at its start only and must hold a digit.
_RUN = r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]{5,}+(?:\.[A-Za-z0-9_-]{5,}+){1,2}|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+)"
CANDIDATE = rf"(?<=[=:>\s\"'`])(?:{'|'.join(_VALUES)})|{_RUN}"
# A text without this has no value of a keyword.
_NAMED = rf"{KEYWORDS}{_GIVEN}|\b(?i:bearer)\s|{_LOGIN}[^\s/@]"
# Kinds that show by their own form.
PREFIXES = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[\w-]{10,}"
    r"|[sr]k_(?:live|test)_\w{10,}|sk-[\w-]{20,}|AIza[\w-]{35}|npm_\w{36}|hf_[A-Za-z0-9]{30,}|eyJ[\w-]{5,}\.[\w-]{5,})"
)
# What shows that a finding is none: the parts of its path, what stands for a value, what names a digest.
SAMPLE_PARTS = r"(?i)(?:^|[/._-])(?:tests?|examples?|samples?|fixtures?|docs?|mocks?)(?:[/._-]|$)"
PLACEHOLDER = (
    r"(?i)example|placeholder|change_?me|your[_-]|dummy|x{6}|\*{4}|^[<$%{\[]|getenv|environ|process\.env|\(\)"
    r"|^(?:true|false|none|null|undefined|string|required|optional)\W*$"
)
DIGEST = r"(?i)\b(?:sha-?[0-9]+|md5|commit|checksum|digest|integrity)\W{0,4}$"
SLUG = r"^(?:[A-Z]?[a-z]+|[0-9]{1,4})(?:[/_+-](?:[A-Z]?[a-z]+|[0-9]{1,4}))+$"
SAMPLES = r"(?i)test|example|sample|fixture|doc|mock"

FEATURES = [
    "length", "kind_changes", "case_changes", "digits", "uppers", "distinct", "vowels", "hexadecimal",
    "coverage", "slashes", "signs", "blanks", "sample_path", "path_depth", "keyword_before", "keyword_after", "assigned", "named", "prefix", "quoted",
]


def findings(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """(doc_id, place, candidate, before, after, path): all candidates with the text around them.

    A null text has none; ``place`` counts a document's candidates from 0.
    """
    text = F.col(text_column)
    named = text.rlike(r"[=:]|(?i:bearer)\s") & text.rlike(_NAMED)
    found = documents.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(path_column).cast("string"), F.lit("")).alias("path"),
        F.when(named, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
        .when(text.rlike("[0-9]|eyJ"), F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)))
        .alias("found"),
        named.alias("named"),
        text.alias("text"),
    ).filter(F.size("found") > 0)
    cut = found.withColumn("rest", F.when(F.col("named"), F.split("text", CANDIDATE, -1)).otherwise(F.split("text", _RUN, -1)))
    each = F.transform(
        "found",
        lambda c, i: F.struct(
            i.alias("place"),
            c.alias("candidate"),
            F.substring(F.element_at("rest", i + 1), -BEFORE, BEFORE).alias("before"),
            F.substring(F.element_at("rest", i + 2), 1, AFTER).alias("after"),
        ),
    )
    return cut.select("doc_id", "path", F.explode(each).alias("x")).select("doc_id", "x.place", "x.candidate", "x.before", "x.after", "path")


def rule_label(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 for every kind of secret that is named here, 0 where a rule shows that it is none, else null.

    Kinds: known prefixes, and the value of any of ``KEYWORDS`` (a plain word after a colon
    may be prose and has no label). None are: findings under a path of examples,
    placeholders, and, unless a keyword names them, numbers with a Luhn check digit,
    digests that are called so and words joined by signs.
    """
    c, before = F.col("candidate"), F.col("before")
    named = before.rlike(ASSIGNED)
    prose = c.rlike(r"^[A-Za-z]+\W?$") & before.rlike(r":\s*$")
    number = F.when(c.rlike("^[0-9][0-9-]*$") & F.length(digits_of(c)).between(13, 19), luhn_sum(digits_of(c)) % 10 == 0).otherwise(False)
    return found.withColumn(
        "label",
        F.when(F.col("path").rlike(SAMPLE_PARTS) | c.rlike(PLACEHOLDER), 0)
        .when(c.rlike(PREFIXES), 1)
        .when(named, F.when(~prose & ~number, 1))
        .when(number | before.rlike(DIGEST) | c.rlike(SLUG), 0),
    )


def dictionary(found: DataFrame) -> list[str]:
    """The most frequent words of four letters or more around candidates: a list of bounded length."""
    words = found.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS)
    return [r["word"] for r in top.collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate")
    lower = F.lower(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    covered = F.aggregate(
        F.array(*map(F.lit, words)).cast("array<string>"),
        F.lit(0),
        lambda s, w: s + F.when(lower.contains(w), F.length(w)).otherwise(0),
    )
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.withColumns(
        {
            "length": n.cast("double"),
            "kind_changes": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
            "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "vowels": share("[AEIOUaeiou]"),
            "hexadecimal": flag(c.rlike("^[0-9a-f]+$")),
            "coverage": F.least(F.lit(1.0), covered / n),
            "slashes": share("/"),
            "signs": share("[^A-Za-z0-9]"),
            "blanks": share(r"\s"),
            "sample_path": flag(F.col("path").rlike(SAMPLES)),
            "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "keyword_before": flag(F.col("before").rlike(KEYWORDS)),
            "keyword_after": flag(F.col("after").rlike(KEYWORDS)),
            "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
            "named": flag(F.col("before").rlike(ASSIGNED)),
            "prefix": flag(c.rlike(PREFIXES)),
            "quoted": flag(F.col("before").rlike(r"[\"']$")),
        }
    )


def trained(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """The forest from rows with features and a label; none if a label is missing altogether."""
    order = F.xxhash64("candidate", "before", "after", F.lit(SEED))
    sample = None
    for label in (0, 1):
        part = labelled.filter(F.col("label") == label).orderBy(order, "candidate", "before", "after", "doc_id", "place").limit(TRAIN_ROWS)
        sample = part if sample is None else sample.union(part)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", F.col("label").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    # One partition of bounded size: the fit doesn't depend on how rows were dealt.
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows.coalesce(1))


def scanned(found: DataFrame) -> DataFrame:
    """``found`` (with ``label``) with ``probability`` of being a secret and ``kept``.

    Without labels of both kinds nothing can be told apart: the probability is null and
    all findings are kept. Findings are stored once, as dictionary, samples and scores
    each read them; equal rows are scored each.
    """
    found = stored(found, "findings")
    rows = with_features(found, dictionary(found))
    model = trained(rows)
    if model is None:
        return rows.drop(*FEATURES).withColumn("probability", F.lit(None).cast("double")).withColumn("kept", F.lit(True))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    scored = scored.withColumn("probability", vector_to_array("probability")[1])
    return scored.drop(*FEATURES, "features", "rawPrediction", "prediction").withColumn("kept", F.col("probability") >= THRESHOLD)
