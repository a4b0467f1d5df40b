"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table

#: A value after an assignment to a telling name, or a run of at least 20 characters of base64 or hexadecimal with a digit.
ASSIGNED = r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?<![A-Za-z0-9_])[^\s\"'<>,;]{8,}+"
BARE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+"
CANDIDATE = f"{ASSIGNED}|{BARE}"
#: Characters of context kept on each side.
CONTEXT = 48
THRESHOLD = 0.5
TREES, DEPTH, SEED = 30, 7, 7
#: Labelled findings that a forest is trained on, at most, by a hash of the finding.
TRAINING_ROWS = 20_000

FEATURES = ["length", "digit_share", "upper_share", "hex_share", "symbol_share", "transitions", "distinct_share", "longest_run", "dictionary", "placeholder", "in_path", "keyword", "assigned", "quoted", "calm_words"]

#: Words of the dictionary: the most frequent ones of the corpus, by rows they are counted in.
DICTIONARY_WORDS = 2000
#: Words that code and configuration add to what a corpus says. Fixed values.
CODE_WORDS = ("example", "sample", "test", "default", "user", "name", "file", "path", "data", "config", "index", "image", "page", "document", "version", "release", "module", "package", "service", "client", "server", "class", "function", "value", "string", "number", "table", "column", "customer", "order", "message", "content", "public", "static", "build", "report", "monthly")
#: What stands in for a secret. Fixed values.
PLACEHOLDER = r"(?i)x{5,}|\*{4,}|\.{3,}|0{8,}|1234567|abcdef(?:g|$)|changeme|placeholder|dummy|your[_-]|<[a-z_]+>|\$\{|\{\{|example|sample|redacted"


def candidates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, value, before, after): every candidate in every whole text, from left to right without overlap.

    start counts code points from 0. before and after are up to CONTEXT characters around the value; for an assigned value, before includes
    its name. Null or empty text: no candidate.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.filter(F.col("_text").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all("_text", F.lit(f"({CANDIDATE})"), 1).alias("_found"), F.split("_text", CANDIDATE, -1).alias("_gaps"))
    around = F.transform(
        "_found",
        lambda m, i: F.struct(
            i.alias("k"),
            m.alias("match"),
            F.right(F.get("_gaps", i), F.lit(CONTEXT)).alias("left"),
            F.left(F.get("_gaps", i + 1), F.lit(CONTEXT)).alias("after"),
            F.length(F.get("_gaps", i)).cast("long").alias("gap"),
        ),
    )
    each = rows.select("doc_id", "_row", F.explode(around).alias("_m")).select("doc_id", "_row", "_m.*")
    # What lies before a match, as a running sum along its own document: linear in the candidates, of which there are few.
    along = Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("at", F.sum(F.col("gap") + F.length("match")).over(along) - F.length("match"))
    name = F.regexp_extract("match", r"^([A-Za-z_-]+[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?=[^\s\"'<>,;]{8})", 1)
    name = F.when(F.col("match").rlike(f"^(?:{ASSIGNED})$"), name).otherwise("")
    each = each.withColumn("_name", name)
    value = F.substring(F.col("match"), F.length("_name") + 1, F.length("match"))
    return each.select("doc_id", (F.col("at") + F.length("_name")).alias("start"), value.alias("value"), F.right(F.concat("left", "_name"), F.lit(CONTEXT)).alias("before"), F.col("after"))


def dictionary(docs: DataFrame, *, words: int = DICTIONARY_WORDS, text: str = "text") -> tuple[str, ...]:
    """The `words` most frequent lower-case words of 4 to 12 letters in all whole texts, ties by code point, and CODE_WORDS.

    Every text adds each of its words once. Counts are added up before the shuffle; `words` rows come to the driver.
    """
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(r"(?<![\p{L}0-9_])(\p{L}{4,12})(?![\p{L}0-9_])"), 1))).alias("word"))
    top = each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(words).collect()
    return tuple(sorted({r["word"] for r in top} | set(CODE_WORDS)))


def _share(value: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(value, outside, "")) / F.greatest(F.length(value), F.lit(1))


def features(found: DataFrame, words: tuple[str, ...] = CODE_WORDS) -> DataFrame:
    """found with the columns FEATURES, all from value, before and after. dictionary: the share of the value's characters in runs of letters
    (cut where a small letter meets a capital) that are among `words`."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    pieces = F.split(F.lower(F.regexp_replace(v, r"(\p{Ll})(\p{Lu})", "$1 $2")), r"[^\p{L}]+")
    covered = F.aggregate(F.filter(pieces, lambda w: w.isin(list(words))), F.lit(0), lambda n, w: n + F.length(w))
    letters = F.filter(F.split(v, ""), lambda c: c != "")
    longest = F.array_max(F.transform(F.split(kinds, "[^a]+"), F.length))
    near = F.lower(F.substring(F.col("before"), -24, 24))
    return (
        found.withColumn("length", F.log1p(n.cast("double")))
        .withColumn("digit_share", _share(v, "[^0-9]"))
        .withColumn("upper_share", _share(v, "[^A-Z]"))
        .withColumn("hex_share", _share(v, "[^0-9a-fA-F]"))
        .withColumn("symbol_share", _share(v, "[A-Za-z0-9]"))
        .withColumn("transitions", (F.length(runs) - 1) / n)
        .withColumn("distinct_share", F.size(F.array_distinct(letters)) / F.least(n, F.lit(64)))
        .withColumn("longest_run", F.coalesce(longest, F.lit(0)) / n)
        .withColumn("dictionary", covered / n)
        .withColumn("placeholder", v.rlike(PLACEHOLDER).cast("double"))
        .withColumn("in_path", (F.col("before").rlike(r"(?:/|\\|://\S*|www\.\S*)$") | v.rlike(r"^/|/[a-z]+/") | F.col("after").rlike(r"^[/\\.]")).cast("double"))
        .withColumn("keyword", near.rlike(r"token|secret|passw|pwd|api.?key|access.?key|auth|credential|private").cast("double"))
        .withColumn("assigned", near.rlike(r"[:=]\s*[\"']?$").cast("double"))
        .withColumn("quoted", near.rlike(r"[\"']$").cast("double"))
        .withColumn("calm_words", near.rlike(r"commit|sha|hash|digest|uuid|checksum|etag|version|revision|build|integrity|card|phone|isbn|order").cast("double"))
    )


def labelled_findings(spark: SparkSession, n: int = 6000, words: tuple[str, ...] = CODE_WORDS) -> DataFrame:
    """(value, before, after, label, kind): findings with known labels, made by rule and the same on every run.

    Label 1: random hexadecimal, base64 and mixed keys after assignments, or alone near a telling word. Label 0: placeholders, identifiers
    and `words` assigned to the same names, checksums and ids near calm words, paths and long numbers.
    """
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    pick = lambda k, options: F.get(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(options))).cast("int"))
    size = (F.pmod(F.xxhash64(F.lit("size"), "id"), F.lit(25)) + 16).cast("int")
    base64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "=", "")
    names = ("token", "secret", "password", "api_key", "access_key", "auth_token", "API_KEY", "client_secret", "SECRET", "credential")
    words = tuple(words)[:: max(1, len(words) // 200)]
    assign = F.concat(pick("name", names), pick("sign", (" = \"", "=", ": ", " = ", "='", ": \"")))
    filler = F.concat(pick("f1", ("the ", "and ", "of the ", "config ", "\n", "export ", "  ", "see ")), F.lit(""))
    tail = pick("tail", ("\"", "\n", " and", "", "' ", " the", "\";"))
    join = pick("join", ("_", "-", "/", "."))
    wordy = F.concat(pick("w1", words), join, pick("w2", words), join, pick("w3", words), join, F.pmod(F.xxhash64("id"), F.lit(100)).cast("string"))
    kind = F.pmod(F.col("id"), F.lit(12))
    value = (
        F.when(kind == 0, F.substring(h("a"), 1, 40))
        .when(kind == 1, F.expr("substring(_b64, 1, _size + 4)"))
        .when(kind == 2, F.concat(pick("pre", ("AKIA", "ghp_", "sk_live_", "xoxb-", "AIza")), F.expr("substring(_b64, 1, _size)")))
        .when(kind == 3, F.substring(h("c"), 1, 32))
        .when(kind == 4, F.concat(F.upper(F.substring(h("d"), 1, 16)), F.substring(h("e"), 1, 24)))
        .when(kind == 5, F.expr("substring(_b64, 1, 40)"))
        .when(kind == 6, pick("ph", ("xxxxxxxxxxxxxxxxxxxx", "your_api_key_here_1", "changeme12345", "0000000000000000000000", "example-token-1234567", "<your_token_here>", "placeholder_value_1", "abcdefghijklmnop1234")))
        .when(kind == 7, wordy)
        .when(kind == 8, F.substring(h("f"), 1, 40))
        .when(kind == 9, F.concat_ws("-", F.substring(h("g"), 1, 8), F.substring(h("g"), 9, 4), F.substring(h("g"), 13, 4), F.substring(h("g"), 17, 4), F.substring(h("g"), 21, 12)))
        .when(kind == 10, F.concat(F.lit("/"), pick("w1", words), F.lit("/"), F.substring(h("h"), 1, 12), F.lit("/"), pick("w2", words)))
        .otherwise(F.lpad(F.conv(F.substring(h("i"), 1, 15), 16, 10), 20, "4"))
    )
    before = (
        F.when(kind.isin(0, 1, 2, 4, 6), F.concat(filler, assign))
        .when(kind == 3, F.concat(filler, assign))
        .when(kind == 5, F.concat(filler, pick("near", ("private key ", "the token is ", "password ", "Authorization Bearer "))))
        .when(kind == 7, F.concat(filler, F.when(F.pmod(F.col("id"), F.lit(2)) == 0, assign).otherwise(pick("plain", ("open ", "in ", "file ", "run ")))))
        .when(kind == 8, F.concat(filler, pick("calm", ("commit ", "sha1: ", "checksum = ", "digest: ", "revision "))))
        .when(kind == 9, F.concat(filler, pick("calm9", ("uuid ", "id: ", "order ", "etag = ", "build "))))
        .when(kind == 10, F.concat(filler, pick("path", ("https://host.example", "/srv", "C:\\", "www.host.example"))))
        .otherwise(F.concat(filler, pick("num", ("card ", "call ", "number ", "of "))))
    )
    rows = spark.range(n).withColumn("_b64", base64).withColumn("_size", size)
    return rows.select(value.alias("value"), before.alias("before"), tail.alias("after"), (kind <= 5).cast("double").alias("label"), kind.cast("int").alias("kind"))


def train(findings: DataFrame, words: tuple[str, ...] = CODE_WORDS, *, rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest over FEATURES from labelled findings (value, before, after, label 0/1), at most `rows` of them, chosen by hash."""
    order = [F.xxhash64("value", "before"), "value", "before", "label"]
    picked = features(findings.filter(F.col("label").isNotNull()).orderBy(*order).limit(rows), words)
    data = materialize(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(picked).select("features", "label").coalesce(4), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt", maxMemoryInMB=64).fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: tuple[str, ...] = CODE_WORDS, *, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per candidate: (doc_id, start, length, value_sha256, score, is_secret). Values leave only as digests.

    words: the dictionary that the model was trained with. Null, empty and clean texts give no row; null ids and repeated rows are carried,
    each with its own candidates; other columns are ignored; an empty table gives no row. Texts and candidates may be of any length.
    All in the JVM; only candidates are shuffled.
    """
    found = features(candidates(docs, text=text, doc_id=doc_id), words)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found).withColumnRenamed("_features", "features")
    judged = model.transform(ready).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return judged.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    words = dictionary(docs)
    return scan(docs, train(labelled_findings(spark, words=words), words), words)
