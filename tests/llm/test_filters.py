"""Quality rules, url filters, secrets, toxicity and chat formatting."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import chat_format, quality, secret_scan, toxicity, url_filter

from .conftest import prose


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    on = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    failed = len(words) < 50 or 100 * len(on) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(on), failed)


@pytest.mark.parametrize("text", [None, "", " \n", "a b c a b c", "É é\u00a0x\n\nÉ é\u00a0x\nÉ é\u00a0x \n# |", prose(1, 200), prose(2, 30) + "\n" + prose(2, 30), "x" * 5000])
def test_base_counts(text):
    assert quality.measure(text)[:6] == slow_measures(text)


def test_verdicts():
    clean = prose(5, 300)
    assert quality.measure(clean)[6]
    assert not quality.measure(" ".join(f"{w}###" for w in clean.split()))[6]
    assert not quality.measure("\n".join([prose(6, 60)] * 6))[6]


def test_quality_rows(odd, nothing):
    got = {(r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in quality.measure_quality(odd).collect()}
    assert got == {(r["doc_id"], *(m := slow_measures(r["text"]))[:1], m[4]) for r in odd.select("doc_id", "text").collect()}
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns and kept.filter("kept != 'own kept'").count() == 0
    assert kept.count() == sum(quality.measure(r["text"])[6] for r in odd.select("text").collect())
    assert quality.measure_quality(nothing).count() == 0 and quality.keep_quality(nothing).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.Net/x"), (2, "https://example.net/en/1?q"), (3, "x://sub.example.com/de/#a"), (4, "http://b.org/fr/"), (5, None), (6, "nonsense"), (7, "http://b.net"), (8, "http://notexample.com/de/"), (9, "http://e.org/FR/"), (None, "http://e.org?x=/fr/"), (9, "http://e.org/FR/")]
    pages = spark.createDataFrame([(i, u, "fine text", "own") for i, u in rows], "page_id long, url string, html string, host string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert got == {
        (1, "a.net", "/x", "net/", "block"), (2, "example.net", "/en/1", "example.net/en/", "allow"), (3, "sub.example.com", "/de/", "example.com/de/", "block"), (4, "b.org", "/fr/", "org/fr/", "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "b.net", "", None, "allow"), (8, "notexample.com", "/de/", None, "allow"), (9, "e.org", "/FR/", None, "allow"), (None, "e.org", "", None, "allow"),
    }
    assert url_filter.filter_urls(pages.filter("page_id < 0")).count() == 0


def test_bad_hosts_are_blocked_and_thin_ones_lean_on_their_domain(spark):
    rows = [(f"bad{i}.spam.example", 1) for i in range(5) for _ in range(20)] + [("new.spam.example", None)] + [(f"h{i}.good.example", 0) for i in range(30) for _ in range(10)] + [("one.good.example", 1)]
    rows += [(f"x{i}.a.co.uk", 0) for i in range(9)] + [("b.co.uk", 1)]
    rep = {r["host"]: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, failed int")).collect()}
    assert rep["bad0.spam.example"]["bound"] > rep["bad0.spam.example"]["bar"] and rep["new.spam.example"]["mean"] > 0.5
    assert rep["one.good.example"]["bound"] < rep["one.good.example"]["bar"] and rep["h0.good.example"]["mean"] < 0.1
    assert rep["x1.a.co.uk"]["mean"] < rep["b.co.uk"]["mean"]  # two domains, not two hosts of one


def test_rare_bad_hosts_among_many_good_ones_are_blocked(spark):
    hosts = spark.range(20_000).selectExpr("concat('h', id, '.d', id % 700, '.com') AS host", "id", "explode(sequence(1, 13)) AS k")
    good = hosts.selectExpr("host", "CAST(pmod(xxhash64(id, k), 1000) < 76 AS INT) AS failed")
    bad = spark.range(20).selectExpr("concat('bad', id, '.e', id, '.com') AS host", "explode(sequence(1, 40)) AS k").selectExpr("host", "1 AS failed")
    rep = url_filter.host_reputation(good.union(bad)).withColumn("blocked", F.col("bound") > F.col("bar"))
    assert rep.filter("host LIKE 'bad%' AND blocked").count() == 20
    assert rep.filter("host NOT LIKE 'bad%' AND blocked").count() < 20  # of 20,000, by chance


def test_the_reputation_decides_where_no_rule_fits(spark):
    rows = [(i, f"http://www.cheap-pills.org/{i}", "fine text " * 30) for i in range(20)] + [(100 + i, f"http://www.good{i % 5}.org/{i}", "fine text " * 30) for i in range(200)]
    rows += [(400, "http://www.cheap-pills.org/fr/x", "fine"), (401, "http://www.good1.org/z", None), (402, "http://www.good1.org/" + "y" * 100_000, "#" * 300_000)]
    rows += [rows[0], rows[0]]
    got = [(r["page_id"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows) and sum(i == 0 for i, _ in got) == 3
    assert all(v == ("block" if i < 20 else "allow") for i, v in got)


def test_secret_candidates_have_their_places(spark):
    text = 'see token = "0123456789abcdef0123456789abcdef01234567" é and https://h.example/a/b3b3b3b3b3b3b3b3b3b3b3 or password: hunter2hunter2'
    got = sorted((r["start"], r["value"]) for r in secret_scan.candidates(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect())
    assert [v for _, v in got][0] == "0123456789abcdef0123456789abcdef01234567" and got[-1][1] == "hunter2hunter2"
    assert all(text[s : s + len(v)] == v for s, v in got)


def test_long_secrets_are_found_whole(spark):
    long = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(80))
    values = [long, long[:200] + long[:3000], "eyJ0" + long[:30] + "." + long[:220] + "." + long[:43], long + "9" * 300_000]
    rows = [(i, f'see token = "{v}" and more') for i, v in enumerate(values)] + [(10, f"bare {long} run")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["value"]) for r in secret_scan.candidates(df).collect()}
    assert got == {i: (13, v) for i, v in enumerate(values)} | {10: (5, long)}
    model = secret_scan.train(secret_scan.labelled_findings(spark, 3000))
    found = secret_scan.scan(df, model).collect()
    assert {r["doc_id"]: (r["length"], r["value_sha256"]) for r in found} == {i: (len(v), hashlib.sha256(v.encode()).hexdigest()) for i, (_, v) in got.items()}
    assert all(r["is_secret"] for r in found if r["doc_id"] < 2)


def test_many_candidates_in_one_text_cost_time_in_proportion(spark):
    import time

    keys = ["k" + hashlib.sha256(str(i).encode()).hexdigest()[:31] + "7" for i in range(20_000)]
    texts = [" é ".join(keys), " é ".join(keys)]  # the same row twice
    df = spark.createDataFrame([(1, t, "own") for t in texts], "doc_id long, text string, value string")
    began = time.perf_counter()
    got = secret_scan.candidates(df).collect()
    assert time.perf_counter() - began < 60
    assert len(got) == 40_000 and sorted(r["start"] for r in got)[::2] == [i * 36 for i in range(20_000)]
    assert {r["value"] for r in got} == set(keys)


def test_lookalikes_planted_in_prose_are_told_from_keys(spark):
    """Findings that the forest was not trained on, inside texts, by kind; the words are the texts' own."""
    from .conftest import documents

    held = secret_scan.labelled_findings(spark, 4800).exceptAll(secret_scan.labelled_findings(spark, 3600)).collect()
    rows = [(i, f"{prose(i, 40)} {r['before']}{r['value']}{r['after']} {prose(i + 5000, 40)}", "en", "s") for i, r in enumerate(held)]
    docs = documents(spark, rows)
    words = secret_scan.dictionary(docs, words=500)
    assert "that" in words and "monthly" in words
    model = secret_scan.train(secret_scan.labelled_findings(spark, 3600, words), words)
    found = {(r["doc_id"], r["value_sha256"]): r["is_secret"] for r in secret_scan.scan(docs, model, words).collect()}
    by = {1.0: [], 0.0: []}
    for i, r in enumerate(held):
        by[r["label"]].append(found.get((i, hashlib.sha256(r["value"].encode()).hexdigest()), False))
    recall, alarms = sum(by[1.0]) / len(by[1.0]), sum(by[0.0]) / len(by[0.0])
    print(f"recall {recall:.3f}, lookalikes taken for keys {alarms:.3f}")
    assert recall > 0.9 and alarms < 0.05


def test_forest_tells_keys_from_lookalikes(spark, nothing):
    model = secret_scan.train(secret_scan.labelled_findings(spark, 3000))
    rows = [(1, 'x token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" y'), (2, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b done"), (3, "password = your_password_here_1"), (4, "plain words only"), (None, 'secret: "Zx9Q1mPb7Lr2Kt8Vw4Yd6"')]
    found = {r["doc_id"]: r["is_secret"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == {1: True, 2: False, 3: False, None: True}
    assert secret_scan.scan(nothing, model).count() == 0
    held = secret_scan.features(secret_scan.labelled_findings(spark, 4000).exceptAll(secret_scan.labelled_findings(spark, 3000)))
    from pyspark.ml.feature import VectorAssembler

    judged = model.transform(VectorAssembler(inputCols=secret_scan.FEATURES, outputCol="features").transform(held))
    assert judged.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95


def test_folding():
    assert toxicity.fold("1D10T, ｉｄｉｏｔ; ідіот id\u200biot!") == " idiot idiot ідіот idiot ".replace("ідіот", toxicity.fold("ідіот").strip())
    assert toxicity.fold("ѕсum $cum s@d") == " scum cum sad ".replace(" cum ", toxicity.fold("$cum"))
    assert toxicity.fold(None) == "  " and toxicity.fold("") == "  "


def test_exceptions_and_length():
    model = toxicity.ToxicityModel({"trash": 5.0, "idiot": 6.0}, (-5.0, 0.5, 2.0))
    assert model.features("put it in the trash can")[0] == 0.0
    assert model.features("you trash, you 1diot")[0] == 11.0
    assert model.score("trash idiot") > model.score("trash idiot " + prose(1, 400)) > model.score(prose(1, 400))
    assert model.score(None) == model.score("") == model.score("harmless")


def test_hits_and_phrases_equal_brute_force():
    import random
    import time

    model = toxicity.ToxicityModel({"trash": 5.0, "idiot": 6.0, toxicity.fold("clown").strip(): 2.0}, exceptions=("trash can", "the trash can of", "idiot proof clown"))
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice(["the", "trash", "can", "of", "idiot", "proof", "clown", "trashy"]) for _ in range(r.randrange(12))]
        free = [True] * len(words)
        for phrase in (p.split() for p in model.exceptions):
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    free[i : i + len(phrase)] = [False] * len(phrase)
        want = sum(w for word, ok in zip(words, free, strict=True) for e, w in model.entries.items() if ok and toxicity.fold(word).strip().startswith(e))
        assert model.features(" ".join(words))[0] == want
    began = time.perf_counter()
    assert model.features("the trash can of " * 100_000)[0] == 0.0
    assert time.perf_counter() - began < 10


def test_toxicity_takes_repeated_rows_and_clashing_columns(spark):
    model = toxicity.ToxicityModel({"trash": 5.0}, (-5.0, 0.5, 2.0))
    rows = [(1, "you trash", 7.0), (1, "you trash", 7.0), (None, None, 7.0), (2, "fine " * 400_000 + "trash", 7.0)]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    want = sorted((str(i), model.score(t)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == want and model.score(rows[3][1]) > model.score("fine")


def test_toxicity_learns_from_its_fold_only(spark, nothing):
    rows = [(i, prose(i, 80) + (" you vile idiot and scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").withColumn("quality", F.lit(1))
    model = toxicity.train(df.drop("toxic"), labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(df.drop("toxic"), flipped).coefficients == model.coefficients
    got = toxicity.score_toxicity(df.drop("toxic"), model).join(labels, "doc_id")
    assert got.filter("held_out").count() > 50 and got.filter("held_out and predicted != toxic").count() == 0
    assert toxicity.score_toxicity(nothing, model).count() == 0
    empty = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= empty.score("anything") <= 1
    odd = toxicity.score_toxicity(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), model).collect()
    assert all(r["predicted"] == 0 for r in odd)


TALKS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a \\ <|im_end|> b"), (1, 2, "assistant", "<|x\\<|"), (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "last"),
    (2, 0, "user", "only me"), (3, 0, "assistant", None), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"), (4, None, None, "first\n"), (None, 0, "odd\nrole<|", "x"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "own") for t in TALKS], "conv_id long, turn long, role string, text string, example string")
    examples = chat_format.expand(df)
    plain = {}
    for c, t, r, x in sorted(TALKS, key=lambda t: (str(t[0]), t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        plain.setdefault(c, []).append((r or "", x or ""))
    rows = examples.collect()
    for r in rows:
        assert r["text"].count("<|im_start|>") == r["n_turns"] == r["text"].count("<|im_end|>\n")
    for c, turns in plain.items():
        own = sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["example"])
        replies = [x for role, x in turns if role == "assistant"]
        assert sum(r["trained"] for r in own) == len(replies) and sum(r["whole"] for r in own) == 1
        masked = [re.sub(r"(?s)\\(.)", r"\1", r["text"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]) for r in own if r["trained"]]
        assert masked == replies
    got = {r["conv_id"]: r for r in chat_format.digests(examples).collect()}
    for c, turns in plain.items():
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.expand(df.filter("conv_id < 0")).count() == 0
