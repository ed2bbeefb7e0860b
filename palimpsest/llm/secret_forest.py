"""Secret scan with false-positive removal by a random forest, in DataFrame operations only.

Candidates are words that hold a run of LEAST_RUN or more token characters with a digit and a letter, or
two changes from lower to upper case in it; values of LEAST_VALUE characters or more that are assigned to a name that speaks of secrets (its tail after the speaking
word has NAME_TAIL characters at most), in the
words ahead or inside one word (quotes stripped); passwords in URLs; and words after Bearer. Patterns are tried where a run begins only, so that a run of any length is read once. Each has features of its length, its
character transitions, its coverage by a dictionary of common word parts, path marks and the words around it. A forest trained
from labelled findings (MLlib, in the JVM) is turned into column expressions, so the scan is one projection: no Python
code, no shuffle, no join.

labelled_findings() makes FINDINGS labelled ones by rule from hashes: keys, tokens and passwords against digests, paths,
identifiers, placeholders and words. A value of letters in one case only is a word to the forest, whatever it is assigned to. Another table of the same columns can be given to train().

Defined cases: null or empty texts have no candidates; a word of several runs gives several; texts and words of any length are
scanned whole; repeated rows each give a row; a null id is kept; an empty table gives no rows; redacted() keeps all columns, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import checkpoint

LEAST_RUN = 16
#: Characters of a value that is assigned to a speaking name.
LEAST_VALUE = 4
#: Characters that a speaking name may go on with, as in token_of_the_day.
NAME_TAIL = 64
FINDINGS, TREES, DEPTH, SEED = 6000, 15, 6, 7
#: Token characters.
RUN = r"[A-Za-z0-9_+/=.\-]"
#: Names that secrets are assigned to, names of things that only look like secrets, common word parts.
SPEAKING = "token|secret|passwd|password|pwd|api_?key|apikey|auth|credential|private_?key|access_?key|bearer"
HARMLESS = "sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|guid|id|revision|etag|version|build|path|file|url|ref|isbn"
PARTS = "the|and|tion|ing|ment|able|for|with|that|this|ver|ent|ere|est|ous|com|org|net|www|http|src|lib|usr|var|data|test|example|main|file|index|page|image|user|admin|config|build|news|html|json|eur|eau|que|ung|sch|ich|ción|mente|ado"
#: A word that is worth a look, and what is taken out of it.
BEGIN = rf"(?<!{RUN})"
WORTH = rf"{BEGIN}(?={RUN}{{{LEAST_RUN}}})(?=[A-Za-z_+/=.\-]*[0-9])(?=[0-9_+/=.\-]*[A-Za-z])|{BEGIN}{RUN}*?[a-z][A-Z]{RUN}*?[a-z][A-Z]"
TAKEN = rf"{RUN}{{8,}}+"
#: What is taken out of a word that something is assigned by; name and value in one word; the password in a URL; what stands ahead of a value.
NAME = rf"(?:{SPEAKING})(?:[_\-][a-z0-9_\-]{{0,{NAME_TAIL}}})?"
INSIDE = r"[^\s\"'`,;<>(){}\[\]]"
VALUE = rf"{INSIDE}{{{LEAST_VALUE - 1},}}[^\s\"'`,;<>(){{}}\[\].:]"
ASSIGNED = rf"(?i)({NAME})[\"'`]?[=:]+>?[\"'`]?({VALUE.replace(INSIDE, INSIDE.replace('[^', '[^&'), 1)})"
IN_URL = r"://[^\s/:@]*:([^\s/@]{" + str(LEAST_VALUE) + r",})@"
AHEAD = rf"(?i){NAME}[\"'`]? ?[=:]+>?$|(^|[^a-z])bearer$"
#: A text that may hold anything of that kind.
SPEAKS = rf"(?i){NAME}[\"'`]?\s*[=:]|(^|[^a-z])bearer\s"
FEATURES = ["size", "digits", "uppers", "lowers", "turns", "distinct", "parts", "vowels", "slashes", "dots", "dashes", "hex", "speaking", "harmless", "assigned", "quoted", "placeholder", "known"]


def share(c: Column, pattern: str) -> Column:
    """Of a text's characters, those outside the pattern's complement."""
    return F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1))


def features(value: Column, before: Column, word: Column) -> Column:
    """A struct of FEATURES: value is the candidate, word the whole word that it stands in, before the two words ahead of it."""
    size = F.length(value).cast("double")
    lower = F.lower(value)
    context = F.lower(F.concat_ws(" ", before, F.regexp_extract(word, r"^(.*?)[=:]", 1)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    turns = F.length(F.regexp_replace(F.regexp_replace(value, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", "\u0001"), "[^\u0001]", ""))
    parts = {
        "size": size,
        "digits": share(value, "[^0-9]"),
        "uppers": share(value, "[^A-Z]"),
        "lowers": share(value, "[^a-z]"),
        "turns": turns / F.greatest(size, F.lit(1.0)),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(size, F.lit(1.0)),
        "parts": 1 - F.length(F.regexp_replace(lower, PARTS, "")) / F.greatest(size, F.lit(1.0)),
        "vowels": share(lower, "[^aeiou]"),
        "slashes": F.length(F.regexp_replace(value, "[^/]", "")).cast("double"),
        "dots": F.length(F.regexp_replace(value, "[^.]", "")).cast("double"),
        "dashes": F.length(F.regexp_replace(value, "[^_-]", "")).cast("double"),
        "hex": flag(value.rlike(r"^[0-9a-fA-F]+$")),
        "speaking": flag(context.rlike(rf"(^|[^a-z])({SPEAKING})([^a-z]|$)")),
        "harmless": flag(context.rlike(rf"(^|[^a-z0-9])({HARMLESS})([^a-z0-9]|$)")),
        "assigned": flag(F.concat_ws(" ", before, word).rlike(r"[=:]\s*[\"']?[^\s=:]*$|[=:]")),
        "quoted": flag(word.rlike("[\"'`]")),
        "placeholder": flag(lower.rlike("example|your|xxxx|placeholder|changeme|dummy|1234567|abcdef")),
        "known": flag(value.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-|sk_live_|eyJ[A-Za-z0-9_-]{10,})")),
    }
    return F.struct(*[parts[name].cast("double").alias(name) for name in FEATURES])


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """value, before, word, secret: findings made by rule, half of them secrets.

    What many shapes share is a column of its own first, so that no expression holds another one many times over: the driver plans, compiles and sends what stands here.
    """
    i = F.col("id")
    sha = F.sha2(i.cast("string"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i.cast("string")), 256))), "=", "")
    syllables = F.array(*[F.lit(x) for x in ("the", "tion", "and", "er", "ing", "re", "ment", "ou", "ble", "an", "eau", "que", "ung", "sch", "ado", "on")])
    pick = lambda k, m: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(m)).cast("int")
    prose = F.concat_ws("", *[F.element_at(syllables, pick(f"s{k}", 16) + 1) for k in range(6)])
    wordy = F.element_at(syllables, pick("w", 16) + 1)
    names = F.array(*[F.lit(x) for x in ("token", "api_key", "password", "secret", "auth_token", "access_key", "TOKEN", "API_KEY", "PASSWORD", "SECRET")])
    plain = F.array(*[F.lit(x) for x in ("sha256", "commit", "checksum", "md5", "digest", "uuid", "revision", "etag", "hash", "build")])
    name, thing = F.element_at(names, pick("n", 10) + 1), F.element_at(plain, pick("p", 10) + 1)
    shared = {"sha": sha, "b64": b64, "prose": prose, "wordy": wordy, "name": name, "thing": thing}
    parts = spark.range(n).select("id", *[c.alias(x) for x, c in shared.items()])
    sha, b64, prose, wordy, name, thing = map(F.col, shared)
    plain_word = F.substring(F.concat(prose, F.lit("s")), 1, 4 + F.pmod(F.xxhash64(i, F.lit("y")), F.lit(9)).cast("int"))
    upper = lambda c: F.when(pick("u", 3) == 0, F.upper(c)).otherwise(c)
    shapes = [  # secrets
        upper(F.substring(sha, 1, 40)),
        upper(F.substring(sha, 1, 32)),
        F.substring(b64, 1, 40),
        F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", "x"), 1, 36)),
        F.substring(F.regexp_replace(b64, "[/+]", "9"), 1, 20),
        F.concat(F.substring(prose, 1, 1 + pick("l", 8)), F.conv(F.substring(sha, 1, 1 + pick("d", 4)), 16, 10), F.substring(prose, 3, pick("t", 3))),  # a password
        F.concat(F.lit("x"), F.lower(F.substring(sha, 2, 4 + pick("l", 9))), pick("d", 10).cast("string")),
        F.concat(F.initcap(F.substring(prose, 1, 4)), F.substring(F.regexp_replace(b64, "[/+]", "!"), 1, 2 + pick("l", 8)), pick("d", 10).cast("string")),
    ]
    others = [  # not secrets
        F.substring(sha, 1, 40),
        sha,
        F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.substring(sha, 13, 4), F.substring(sha, 17, 4), F.substring(sha, 21, 12)),
        F.concat(F.lit("/usr/lib/"), prose, F.lit("/"), F.substring(sha, 1, 6), F.lit(".json")),
        prose,
        F.concat(F.lit("your_"), F.substring(prose, 1, 6), F.lit("_here_1234567")),
        F.concat(F.lit("www."), F.substring(prose, 1, 10), F.lit(".example.com/page"), F.substring(sha, 1, 3)),
        F.concat(F.initcap(F.substring(prose, 1, 6)), F.initcap(F.substring(prose, 5, 7)), F.initcap(F.substring(prose, 9, 6))),
        F.concat(F.substring(prose, 1, 9), F.lit("."), F.substring(sha, 1, 2), F.lit("@mail"), pick("m", 9).cast("string"), F.lit(".example.com")),
        F.regexp_replace(F.conv(F.substring(sha, 1, 15), 16, 10), "^", "2"),
        plain_word,
        F.initcap(plain_word),
        F.upper(plain_word),
    ]
    choose = lambda listed, key: F.element_at(F.array(*listed), pick(key, len(listed)) + 1)
    secret = (i % 2).cast("int")
    rows = parts.select("*", F.when(secret == 1, choose(shapes, "a")).otherwise(choose(others, "b")).alias("value"))
    value = F.col("value")
    mark = F.element_at(F.array(F.lit("="), F.lit(":")), pick("e", 2) + 1)
    # digests are named as such; placeholders may stand after a secret's name; other things in prose
    before = F.when(secret == 1, F.concat_ws(" ", name, mark)).when(value.rlike("^[0-9a-f-]{36,}$"), F.concat_ws(" ", thing, F.when(pick("c", 2) == 0, mark).otherwise(F.lit("")))).when(value.startswith("your") | value.rlike("^([a-z]+|[A-Z][a-z]+|[A-Z]+)$"), F.concat_ws(" ", name, mark)).otherwise(F.concat_ws(" ", wordy, wordy))
    word = F.when((secret == 1) & (pick("q", 3) > 0), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    return rows.select("value", before.alias("before"), word.alias("word"), secret.alias("secret"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list:
    """The trees of a forest: a leaf is 0 or 1 (a secret), a node is (feature, threshold, tree at or below it, tree above it)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select(features(F.col("value"), F.col("before"), F.col("word")).alias("f"), F.col("secret").cast("double").alias("label")).select("f.*", "label").coalesce(1)
    rows = checkpoint(rows)  # the forest's passes plan and send its numbers, not how they were made
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, maxBins=64).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return [tree_of(t.toDebugString) for t in model.trees]


def tree_of(printed: str):
    """A tree out of its printed form."""
    lines = [x.strip() for x in printed.split("\n") if re.match(r"\s*(If|Else|Predict)", x)]

    def node(at: int):
        line = lines[at]
        if line.startswith("Predict"):
            return int(float(line.split(":")[1])), at + 1
        found = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line)
        yes, at = node(at + 1)
        no, at = node(at + 1)  # at stands on Else
        return (FEATURES[int(found[1])], float(found[2]), yes, no), at

    return node(0)[0]


def voted(tree, f: Column) -> Column:
    """A tree's vote as a column over a struct of FEATURES."""
    if isinstance(tree, int):
        return F.lit(tree)
    feature, threshold, yes, no = tree
    return F.when(f[feature] <= threshold, voted(yes, f)).otherwise(voted(no, f))


def tokens(text: Column) -> Column:
    """A text that may hold a candidate as its words, each with the white space after it, so that together they are the text; of other texts null."""
    worth = text.rlike(WORTH) | text.rlike(SPEAKS) | text.rlike(IN_URL)
    return F.when(worth, F.split(text, r"(?<=\s)(?=\S)"))


def candidates(held: Column, token: Column, i: Column) -> Column:
    """Array of value, before, word: the candidates of one token of an array of tokens, in order of place."""
    bare = lambda t: F.regexp_replace(t, r"\s+$", "")
    word = bare(token)
    earlier = lambda k: F.when(i >= k, bare(F.get(held, i - k))).otherwise("")
    before = F.concat_ws(" ", earlier(2), earlier(1))
    ahead = (i > 0) & (F.length(word) >= LEAST_VALUE) & before.rlike(AHEAD)
    one = lambda value, name, around: F.struct(value.alias("value"), name.alias("before"), around.alias("word"))
    inside = F.zip_with(F.regexp_extract_all(word, F.lit(ASSIGNED), F.lit(1)), F.regexp_extract_all(word, F.lit(ASSIGNED), F.lit(2)), lambda n, v: one(v, F.concat(n, F.lit(" =")), v))
    urls = F.regexp_extract_all(word, F.lit(IN_URL), F.lit(1))
    in_url = F.transform(urls, lambda v: one(v, F.lit("password ="), v))
    rest = F.regexp_replace(word, ASSIGNED, " ")
    runs = F.when(ahead, F.regexp_extract_all(rest, F.lit(VALUE), F.lit(0))).otherwise(F.regexp_extract_all(rest, F.lit(TAKEN), F.lit(0)))
    others = F.transform(F.filter(runs, lambda v: ~F.exists(urls, lambda u: F.contains(u, v))), lambda v: one(v, before, word))
    none = F.array().cast("array<struct<value:string,before:string,word:string>>")
    looked = word.rlike(WORTH) | ahead
    found = F.concat(inside, in_url, F.when(looked, others).otherwise(none))
    in_place = lambda x, y: F.instr(word, x["value"]) - F.instr(word, y["value"])
    return F.when(looked | word.rlike(ASSIGNED) | word.rlike(IN_URL), F.array_sort(found, in_place)).otherwise(none)


def judged(found: Column, forest: list[str]) -> Column:
    """Array of value and secret out of candidates; secret if half of the trees say so or more."""
    made = F.transform(found, lambda x: F.struct(x["value"].alias("value"), features(x["value"], x["before"], x["word"]).alias("f")))
    return F.transform(made, lambda x: F.struct(x["value"].alias("value"), (2 * sum((voted(t, x["f"]) for t in forest[1:]), voted(forest[0], x["f"])) >= len(forest)).alias("secret")))


def fresh(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def secrets(docs: DataFrame, forest: list, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_candidates, secrets (array of texts, in order of place) of every row."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), tokens(F.col(text).cast("string")).alias("held"))
    found = F.coalesce(F.flatten(F.transform("held", lambda t, i: candidates(F.col("held"), t, i))), F.array().cast("array<struct<value:string,before:string,word:string>>"))
    rows = rows.select("doc_id", judged(found, forest).alias("found"))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_candidates"), F.transform(F.filter("found", lambda x: x["secret"]), lambda x: x["value"]).alias("secrets"))


def redacted(docs: DataFrame, forest: list, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every secret replaced by the mask where it stands: in the word that it was found in, longer ones first; all other columns and rows as they are."""
    held = fresh(docs.columns, "tokens")

    def hide(token: Column, i: Column) -> Column:
        found = F.filter(judged(candidates(F.col(held), token, i), forest), lambda x: x["secret"])
        longest = F.array_sort(found, lambda x, y: F.length(y["value"]) - F.length(x["value"]))
        return F.aggregate(longest, token, lambda t, x: F.replace(t, x["value"], F.lit(mask)))

    rows = docs.withColumn(held, tokens(F.col(text).cast("string")))
    hidden = F.array_join(F.transform(held, hide), "")
    return rows.withColumn(text, F.coalesce(hidden, F.col(text))).select(*docs.columns)


def op10_secret_forest(spark, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_findings(spark)))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.sha2(F.array_join("secrets", "\n"), 256).alias("secrets_sha256"))
