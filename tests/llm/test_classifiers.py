"""Classifiers against plain computations, and on hard texts."""

import hashlib
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import host_reputation, quality_crf, secret_forest, toxicity

DATA = "/root/testdata/sf0.001"


def plain_kneser_ney(texts, labels):
    """log p(word | toxic) - log p(word | ordinary) by dictionaries."""
    counts = {n: {} for n in range(1, toxicity.ORDER + 1)}
    for text, label in zip(texts, labels):
        for word in re.findall("[0-9a-z]+", text.lower()):
            s = "\x01" + word + "\x02"
            for n in counts:
                for i in range(len(s) - n + 1):
                    if n > 1 or i:
                        counts[n].setdefault(s[i : i + n], [0, 0])[label] += 1
    adjusted = {}
    for n, held in counts.items():
        ends = {}
        for g, c in counts.get(n + 1, {}).items():
            for k in (0, 1):
                ends.setdefault(g[1:], [0, 0])[k] += c[k] > 0
        for g, c in held.items():
            c = c if n == toxicity.ORDER or g[0] == "\x01" else ends.get(g, [0, 0])
            adjusted[g] = [sum(c)] * 2 if n <= toxicity.SHARED else c
    total, kinds = {}, {}
    for g, c in adjusted.items():
        for k in (0, 1) if len(g) > 1 else ():
            total.setdefault(g[:-1], [0, 0])[k] += c[k]
            kinds.setdefault(g[:-1], [0, 0])[k] += c[k] > 0
    base = [1.0] * 256
    for g, c in adjusted.items():
        if len(g) == 1:
            base[ord(g)] += c[0]
    whole = sum(base)

    def p(s, i, k):
        out = base[ord(s[i])] / whole
        for n in range(2, toxicity.ORDER + 1):
            if i - n + 1 >= 0:
                context = s[i - n + 1 : i]
                t = total.get(context, [0, 0])[k]
                if t:
                    out = (max(adjusted.get(context + s[i], [0, 0])[k] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds[context][k] * out) / t
        return out

    return lambda word: sum(math.log(p("\x01" + word + "\x02", i, 1)) - math.log(p("\x01" + word + "\x02", i, 0)) for i in range(1, len(word) + 2))


def test_kneser_ney_against_dictionaries():
    texts = ["you stupid idiot", "a kind and gentle idea", "idiots are stupid stupid", "the ideal kind of day", "dumb idiotic thing", "nothing of the kind 42"]
    labels = [1, 0, 1, 0, 1, 0]
    model = toxicity.Model(*toxicity.text_grams(pa.array(texts), np.array(labels)))
    words = ["idiot", "kind", "stupid", "ideas", "zzz", "idiotically", "a", "42"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = model.words(data, ends - [len(w) for w in words], ends)
    plain = plain_kneser_ney(texts, labels)
    assert np.allclose(got, [plain(w) for w in words], rtol=1e-5, atol=1e-5)
    assert got[0] > 0 > got[1]


def test_wordless_texts_are_not_dropped(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " !? "), (None, "")], "doc_id long, text string")
    mostly = labels.withColumn("toxic", (F.col("doc_id") % 3 > 0).cast("int"))
    assert toxicity.ordinary(odd, toxicity.fit(docs, mostly, F.lit(True)), 0.3).count() == 4
    assert toxicity.ordinary(docs, toxicity.fit(docs, labels.withColumn("toxic", F.lit(1)), F.lit(True)), 0.3).count() == docs.count()


def test_long_lines_are_measured_whole():
    text = "A" * 2_200_000 + "\n" + "a1 |" * 10
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    own, bounds, size = quality_crf.own_features(data, offsets)
    names = list(quality_crf._IS)
    assert size.tolist() == [2_200_000, 40] and bounds.tolist() == [0, 2]
    assert own[0, 1 + names.index("upper")] == 1 and own[0, 1 + names.index("digit")] == 0
    assert own[1, 1 + names.index("bar")] == 0.25 and own[1, 1 + names.index("blank")] == 0.25


def test_repeated_ids_of_different_texts_and_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic")
    more = docs.unionByName(docs.select("doc_id", F.reverse("text").alias("text")))
    twice = labels.unionByName(labels.select("doc_id", (1 - F.col("quality")).alias("quality"), (1 - F.col("toxic")).alias("toxic")).where("doc_id % 7 = 0"))
    for module in (quality_crf, toxicity):
        one, two = (module.scores(docs, module.fit(rows, twice, F.lit(True))).orderBy("doc_id").collect() for rows in (more, more.repartition(5)))
        assert np.allclose([r.score for r in one], [r.score for r in two])


def test_suffixes_and_domains(spark):
    hosts = [("www.example.co.uk", "co.uk", "example.co.uk"), ("co.uk", "co.uk", ".co.uk"), ("a.b.com", "com", "b.com"), ("localhost", "localhost", ".localhost"), ("10.0.0.1", "ip", "10.0.0.1"), ("[::1]", "ip", "[::1]"), ("x.com.au", "com.au", "x.com.au"), ("a.co.com", "com", "co.com"), ("", "", ".")]
    rows = spark.createDataFrame([(h,) for h, *_ in hosts], "h string")
    got = rows.select("h", host_reputation.suffix_of(F.col("h")), host_reputation.domain_of(F.col("h"))).collect()
    assert [tuple(r) for r in got] == hosts
    assert spark.range(1).select(host_reputation.bare(F.lit("me@www.a.com:8080"))).first()[0] == "www.a.com"


def test_repeated_pages_count_each(spark):
    rows = [(i, "http://bad.com/de/1") for i in [1] * 30 + [2]] + [(3, "http://bad.com/en/"), (3, "http://bad.com/en/"), (None, "http://bad.com/x")]
    found = host_reputation.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(found) == len(rows) and {r.verdict for r in found} == {"block"}


# ---------------------------------------------------------------- secrets by plain Python


def java(pattern):
    return re.compile(pattern.replace("}+", "}"))


def plain_candidates(text):
    found = []
    words = re.split(r"\s+", text) if re.search(secret_forest.WORTH, text) or re.search(secret_forest.SPEAKS, text) or re.search(secret_forest.IN_URL, text) else []
    for i, w in enumerate(words):
        before = " ".join([words[i - 2] if i > 1 else "", words[i - 1] if i else ""])
        ahead = i > 0 and len(w) >= secret_forest.LEAST_VALUE and re.search(secret_forest.AHEAD, before)
        if not (ahead or re.search(secret_forest.WORTH, w) or re.search(secret_forest.ASSIGNED, w) or re.search(secret_forest.IN_URL, w)):
            continue
        urls = re.findall(secret_forest.IN_URL, w)
        held = [(v, f"{n} =", v) for n, v in re.findall(secret_forest.ASSIGNED, w)] + [(v, "password =", v) for v in urls]
        if ahead or re.search(secret_forest.WORTH, w):
            rest = re.sub(secret_forest.ASSIGNED, " ", w)
            held += [(v, before, w) for v in java(secret_forest.VALUE if ahead else secret_forest.TAKEN).findall(rest) if not any(v in u for u in urls)]
        found += sorted(held, key=lambda x: w.find(x[0]))
    return found


def plain_features(value, before, word):
    size, lower = len(value), value.lower()
    share = lambda v, keep: sum(bool(re.match(keep, c)) for c in v) / max(len(v), 1)
    ahead = re.match(r"(.*?)[=:]", word)
    context = f"{before} {ahead[1] if ahead else ''}".lower()
    turns = len(re.findall(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", value))
    flags = {
        "hex": re.search("^[0-9a-fA-F]+$", value),
        "speaking": re.search(rf"(^|[^a-z])({secret_forest.SPEAKING})([^a-z]|$)", context),
        "harmless": re.search(rf"(^|[^a-z0-9])({secret_forest.HARMLESS})([^a-z0-9]|$)", context),
        "assigned": re.search(r"[=:]", f"{before} {word}"),
        "quoted": re.search("[\"'`]", word),
        "placeholder": re.search("example|your|xxxx|placeholder|changeme|dummy|1234567|abcdef", lower),
        "known": re.search(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-|sk_live_|eyJ[A-Za-z0-9_-]{10,})", value),
    }
    out = {"size": size, "digits": share(value, "[0-9]"), "uppers": share(value, "[A-Z]"), "lowers": share(value, "[a-z]"), "turns": turns / max(size, 1), "distinct": len(set(value)) / max(size, 1), "parts": 1 - len(re.sub(secret_forest.PARTS, "", lower)) / max(size, 1), "vowels": share(lower, "[aeiou]"), "slashes": value.count("/"), "dots": value.count("."), "dashes": value.count("-") + value.count("_")}
    return out | {k: float(bool(v)) for k, v in flags.items()}


def vote(tree, f):
    return tree if isinstance(tree, int) else vote(tree[2] if f[tree[0]] <= tree[1] else tree[3], f)


def test_secrets_against_plain_python(spark):
    forest = secret_forest.train(secret_forest.labelled_findings(spark))
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += ["", 'x token = "0123456789abcdef0123" password:Tr0ub4dor3 &pwd=abc12345;api_key=Zz9Zz9Zz9', "https://u:s3cretPw99@host.example.com/db", "camelCaseIdentifierName aB1 secret-key => q1w2e3r4t5", "Authorization: Bearer abc123def456"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n_found = 0
    for r in secret_forest.secrets(table, forest).collect():
        held = plain_candidates(texts[r.doc_id])
        secrets = [v for v, b, w in held if 2 * sum(vote(t, plain_features(v, b, w)) for t in forest) >= len(forest)]
        assert (r.n_candidates, r.secrets) == (len(held), secrets), texts[r.doc_id][:200]
        n_found += len(secrets)
    assert n_found > 3


@pytest.mark.parametrize("run", ["a" * 300_000, "aB" * 150_000, "token-" * 50_000, "x" * 150_000 + "1" * 150_000])
def test_long_runs_are_read_once(spark, run):
    forest = secret_forest.train(secret_forest.labelled_findings(spark, 400), 3, 3)
    began = time.time()
    out = secret_forest.secrets(spark.createDataFrame([(1, run)], "doc_id long, text string"), forest).collect()
    assert len(out) == 1 and time.time() - began < 20


def test_redaction_in_place(spark):
    """A value is masked in the word that it was found in, a longer one before a shorter one that begins it, and all white space and columns stay."""
    forest = secret_forest.train(secret_forest.labelled_findings(spark))
    short, long = "abc123def456", "abc123def456ghi789"
    text = f"see\t{short}x  pwd={long}\n\npassword = {short} end"
    rows = spark.createDataFrame([(1, text, "a", [1]), (None, None, "b", None), (2, "", "c", [])], "doc_id long, text string, tokens string, __found array<int>")
    out = {r.doc_id: r for r in secret_forest.redacted(rows, forest).collect()}
    assert out[1].text == f"see\t{short}x  pwd=[secret]\n\npassword = [secret] end"
    assert out[1].tokens == "a" and out[1]["__found"] == [1] and out[None].text is None and out[2].text == ""
    assert secret_forest.secrets(rows.limit(0), forest).count() == 0 and secret_forest.redacted(rows.limit(0), forest).count() == 0


def test_findings_are_planned_and_made_once(spark):
    """The driver holds a small plan of the labelled findings, whose rows are those of before, and the forest's passes don't make its rows anew."""
    found = secret_forest.labelled_findings(spark)
    assert found._jdf.queryExecution().analyzed().toJSON().count("class") < 3_000
    rows = hashlib.md5(str([tuple(r) for r in found.orderBy("value", "before", "word", "secret").collect()]).encode()).hexdigest()
    assert rows == "1b184846f12da0c71812831aa9b5038b"
    made = spark.sparkContext.accumulator(0)

    def counted(row):
        made.add(1)
        return row

    few = secret_forest.labelled_findings(spark, 400)
    forest = secret_forest.train(spark.createDataFrame(few.rdd.map(counted), few.schema), 3, 3)
    assert made.value <= 800 and forest == secret_forest.train(few, 3, 3)
