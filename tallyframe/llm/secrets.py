"""Secret scans: candidates, and a random forest that removes false positives.

DataFrame functions only. Candidates are runs of at least twelve characters of the
kind keys are made of, wherever they stand in a word, with a digit in them or near
a word like "password"; and all of a value of at least eight characters that such
a word names. What tells secrets from other long words - length, character transitions, dictionary coverage, path marks and the
neighbouring words - is computed as columns, and a random forest trained from
labelled findings decides.
"""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: An optional name= or name: (quotes or brackets around), and a run of key characters with any delimiter around it.
RUN = r"""(?:([A-Za-z_][A-Za-z0-9_.-]*+)["')\]}]*[=:]+["'(\[{<]*)?([A-Za-z0-9+/_.@:-]{12,}+(?:={1,2}(?![A-Za-z0-9=]))?)"""

#: Words near secrets, words near other long strings, words inside harmless ones.
NEAR_SECRET = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "credential", "bearer", "private"]
NEAR_OTHER = ["commit", "sha", "hash", "uuid", "guid", "id", "version", "card", "phone", "isbn", "checksum", "digest", "build", "order", "ip", "mail"]
DICTIONARY = ["the", "and", "ing", "tion", "mail", "example", "com", "org", "net", "http", "https", "www", "index", "html", "user", "local", "home", "lib", "python", "test", "data", "file", "image", "page", "main", "doc", "src", "bin", "version", "report", "table", "name", "date", "time", "item", "note", "part", "read", "draft", "final"]

FEATURES = ["length", "transitions", "digits", "uppers", "hex_only", "digits_only", "coverage", "path_marks", "near_secret", "near_other", "known_prefix"]


def _any(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


#: A name that holds a secret word, and its value in the same word or, with the name in the words before, by itself.
NAMED = rf"""(?i)({_any(NEAR_SECRET)}[A-Za-z0-9_.-]*+["')\]}}]*[=:]+["'(\[{{<]*)([^"'<>]{{8,}})"""
NAME_BEFORE = rf"""(?i){_any(NEAR_SECRET)}[A-Za-z0-9_.-]*+["')\]}}]*[\x20]?[=:]+["'(\[{{<]*$"""
ALONE = r"""^["'(\[{<]*([^"'<>]{8,})"""
#: What ends a value: a further assignment, or closing punctuation.
VALUE_END = r"""(?s)[&,;]["']?[A-Za-z_][A-Za-z0-9_.-]*+["']?[=:].*$|[)\]}>,;.]+$"""


def _near(name: Column, before: Column, after: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))))


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of ``before`` (two words), ``after`` (one) and ``name`` and ``candidate``, or else the ``word`` they are in."""
    t = found if "candidate" in found.columns else found.withColumns({"name": F.regexp_extract("word", RUN, 1), "candidate": F.regexp_extract("word", RUN, 2)})
    t = t.withColumn("near", _near(F.col("name"), F.col("before"), F.col("after")))
    size = F.length("candidate").cast("double")
    count = lambda pattern: F.regexp_count("candidate", F.lit(pattern)).cast("double")
    yes = lambda c: c.cast("double")
    values: dict[str, Column] = {
        "length": size,
        "transitions": count(r"(?<=[a-z])(?![a-z])(?!$)|(?<=[A-Z])(?![A-Z])(?!$)|(?<=[0-9])(?![0-9])(?!$)") / size,
        "digits": count("[0-9]") / size,
        "uppers": count("[A-Z]") / size,
        "hex_only": yes(F.col("candidate").rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "digits_only": yes(F.col("candidate").rlike("^[0-9 .:-]+$")),
        "coverage": 1 - F.length(F.regexp_replace(F.lower("candidate"), _any(DICTIONARY), "")) / size,
        "path_marks": count("[/.@:]"),
        "near_secret": yes(F.col("near").rlike(_any(NEAR_SECRET))),
        "near_other": yes(F.col("near").rlike(rf"\b{_any(NEAR_OTHER)}\b")),
        "known_prefix": yes(F.col("candidate").rlike("^(AKIA|ASIA|ghp_|gho_|glpat-|xox[bpas]-|sk-|sk_live_|AIza|eyJ)")),
    }
    return t.withColumns(values).drop("near", "name")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position (of the word in its text, from 0), word, before, after, name, candidate; a word may hold several."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    t = rows.select("doc_id", F.split("text", SPACE).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.length(F.get("w", i)) >= 8)
    found = F.transform(
        at,
        lambda i: F.struct(
            i.alias("position"),
            F.get("w", i).alias("word"),
            F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("before"),
            F.get("w", i + 1).alias("after"),
        ),
    )
    t = t.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")
    runs = F.arrays_zip(F.regexp_extract_all("word", F.lit(RUN), F.lit(1)).alias("name"), F.regexp_extract_all("word", F.lit(RUN), F.lit(2)).alias("candidate"))
    runs = F.filter(runs, lambda r: r["candidate"].rlike("[0-9]") | _near(r["name"], F.col("before"), F.col("after")).rlike(_any(NEAR_SECRET)))
    values = F.arrays_zip(F.regexp_extract_all("word", F.lit(NAMED), F.lit(1)).alias("name"), F.regexp_extract_all("word", F.lit(NAMED), F.lit(3)).alias("candidate"))
    alone = F.array(F.struct(F.lit("").alias("name"), F.regexp_extract("word", ALONE, 1).alias("candidate")))
    values = F.when(F.col("before").rlike(NAME_BEFORE), F.concat(values, alone)).otherwise(values)
    values = F.transform(values, lambda v: F.struct(v["name"].alias("name"), F.regexp_replace(F.regexp_replace(v["candidate"], VALUE_END, ""), VALUE_END, "").alias("candidate")))
    t = t.withColumn("runs", runs)
    values = F.filter(values, lambda v: (F.length(v["candidate"]) >= 8) & ~F.exists("runs", lambda r: r["candidate"] == v["candidate"]))
    return t.withColumn("found", F.explode(F.concat("runs", F.array_distinct(values)))).select("doc_id", "position", "word", "before", "after", "found.name", "found.candidate")


def labelled_findings(spark: SparkSession, each: int = 60, seed: int = 7) -> DataFrame:
    """word, before, after, label: findings made up by kind, ``each`` of every kind.

    Stands in for findings labelled by hand; ``train`` takes any such table.
    """
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexes, upper, alnum = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    prose = lambda: r.choice(["was", "the", "of", "under", "stated", "and", "near", "los", "der", "une", "before"])
    words = lambda n, sep: sep.join(r.choice(DICTIONARY) for _ in range(n))
    rows = []
    for _ in range(each):
        key, other = r.choice(NEAR_SECRET), r.choice(NEAR_OTHER)
        rows += [
            ("AKIA" + pick(upper, 16), f"{prose()} {prose()}", prose(), 1),
            ("ghp_" + pick(alnum, 36), f"{prose()} {prose()}", prose(), 1),
            (f"{key}={pick(hexes, r.randint(14, 40))}", f"{prose()} {prose()}", prose(), 1),
            (f"{key}={pick(alnum, r.randint(14, 40))}", f"{prose()} {prose()}", prose(), 1),
            (f'"{pick(hexes, r.choice([32, 40, 64]))}"', f"{key} =", prose(), 1),
            (f"'{pick(alnum + '+/', r.randint(20, 60))}'", f"{key}:", prose(), 1),
            (pick("456", 1) + pick(string.digits, 15), f"{prose()} {prose()}", prose(), 0),
            (".".join(str(r.randint(100, 255)) for _ in range(4)), f"{prose()} {prose()}", prose(), 0),
            (f"{pick(string.ascii_lowercase, 7)}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", f"{prose()} {prose()}", prose(), 0),
            (f"/{words(r.randint(2, 5), '/')}{r.randint(1, 99)}/{words(1, '')}.html", f"{prose()} {prose()}", prose(), 0),
            (f"https://www.example.com/{words(3, '/')}/{r.randint(1, 9999)}", f"{prose()} {prose()}", prose(), 0),
            (pick(hexes, r.choice([32, 40])), f"{prose()} {other}", prose(), 0),
            ("-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), f"{prose()} {other}", prose(), 0),
            (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}", f"{prose()} {prose()}", prose(), 0),
            (f"{words(3, '_')}{r.randint(1, 999)}", f"{prose()} {prose()}", prose(), 0),
            (f"{other}={r.randint(10**11, 10**14)}", f"{prose()} {prose()}", prose(), 0),
        ]
    return spark.createDataFrame(rows, "word string, before string, after string, label int")


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found))


def train(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest over rows of word, before, after and label (0 or 1)."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return forest.fit(_assembled(labelled).select("features", F.col("label").cast("double")).coalesce(1))


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, position, candidate, before, probability, secret.

    ``secret`` is false for the false positives the forest removes. A null or empty
    text, and a table without rows, has no candidates; repeated rows give repeated
    findings. Words have no greatest length.
    """
    scored = model.transform(_assembled(candidates(docs, id_col, text_col)))
    p = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "position", "candidate", "before", p.alias("probability"), (p >= threshold).alias("secret"))
