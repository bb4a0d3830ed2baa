"""Secret scanning with a random forest against false positives. Built-in functions and Spark's own forest only.

A pattern finds candidates: by place, what is assigned to a credential's name (six characters at least) and the password
in a URL, whatever their letters; and anywhere, runs of 16 token characters at least that hold a digit or a change of
case. Each candidate is described by its length, its character transitions, the share of it that dictionary words cover,
the path or source it comes from, and the words before and after it; a random forest learnt from labelled findings keeps the likely secrets. The
default findings are made by rule from seeded hashes: credentials in the usual shapes and places, and look-alikes
(digests, identifiers, paths, numbers) that are none.

Defined results: null and empty texts have no findings; a value found twice in a text is two findings; repeated rows
report each on its own; a null doc_id or source is kept as null; an empty table gives no rows; further columns stay in
redaction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import written

#: Labelled findings made by default, the forest's size, and the probability from which a finding is reported.
FINDINGS, TREES, DEPTH, THRESHOLD = 4000, 24, 7, 0.5

#: Names that a credential is assigned to (fixed values).
NAMES = "token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credential"
#: A candidate by its place: the password of a URL's user part; what follows a name and a sign of assignment. Short looks
#: back come first, so that the long ones are tried at few places.
IN_URL = r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@]{3,128}(?=@)"
ASSIGNED = rf"(?<=[=:>\"'` \t])(?<=[=:]>?[ \t]{{0,3}}[\"'`]?)(?<=(?i:{NAMES})[A-Za-z0-9_]{{0,12}}[\"'`]?[ \t]{{0,3}}[=:]>?[ \t]{{0,3}}[\"'`]?)[^\s\"'`<>;,=:&(){{}}\[\]][^\s\"'`<>;,&(){{}}\[\]]{{4,255}}[^\s\"'`<>;,&(){{}}\[\].:!?]={{0,2}}"
#: A candidate by itself: a run of token characters with a digit or a change of case (a capital at its beginning is none);
#: marks may stand inside, but not those of a mail address.
RUN = r"(?<![A-Za-z0-9+/_.-])(?<![A-Za-z0-9+/_-][@!#$%^*~])(?![^\s@]*@[^\s@]*\.[A-Za-z]{2})(?=[A-Za-z0-9+/_.@!#$%^*~-]*(?:[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]|A[KS]IA))[A-Za-z0-9+/_-][A-Za-z0-9+/_.@!#$%^*~-]{14,}[A-Za-z0-9+/_-]={0,2}"
CANDIDATE = f"{IN_URL}|{ASSIGNED}|{RUN}"
#: Up to two words before a candidate and its own word's beginning; the rest of its own word; that and up to two words more.
BEFORE, AFTER, NEXT = r"(?:\S{1,64}[ \t]{1,4}){0,2}\S{0,24}$", r"^\S{0,8}", r"^\S{0,8}(?:[ \t]{1,4}\S{1,32}){0,2}"
#: Characters that BEFORE looks at, and pieces that hold as many: every other one is a candidate of 3 at least.
WINDOW, PIECES = 160, 80
#: Bytes of findings that are broadcast at most, when texts are redacted.
BROADCAST_BYTES = 64 << 20
MARK, OTHER = "\u0001", "\u0002"

# Words beside credentials, words beside look-alikes, and common word parts inside identifiers.
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private|signature|client.?id|apikey)"
LOOKALIKE = r"(?i)(commit|sha-?\d|md5|digest|checksum|hash|uuid|guid|revision|\brev\b|etag|build|version|\bid\b|isbn|order|invoice|serial|tracking|href|src|url|path|file|base64,)"
DICTIONARY = r"(?i)(the|and|ing|ion|for|with|that|this|from|user|name|test|example|sample|demo|data|file|page|image|index|content|article|news|html|http|www|com|org|net|config|value|string|number|list|item|table|class|function|main|home|site|post|date|time|year|word|text|line|code)"

FEATURES = ("chars", "digits", "uppers", "symbols", "distinct", "hex", "changes", "vowels", "covered", "credential", "lookalike", "assigned", "quoted", "prefix", "uuid", "path_test", "in_url", "closed", "word_after", "plain")


def candidates(docs: DataFrame, source: Column) -> DataFrame:
    """doc_id, source, place (order in the text), value, before, after, next: one row for each candidate."""
    # pieces of the text: what lies between candidates, and the candidates, in turn; so none hides another
    marked = F.regexp_replace(F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, OTHER), F.lit(CANDIDATE), F.lit(f"{MARK}$0{MARK}"))
    pieces = docs.select("doc_id", source.cast("string").alias("source"), F.split(marked, MARK).alias("pieces"))
    p, n = F.col("pieces"), F.size("pieces")

    def around(i: Column) -> Column:
        """The candidate at place i with the text around it, which may hold other candidates."""
        before = F.array_join(F.slice(p, F.greatest(i - PIECES, F.lit(1)), F.least(i - 1, F.lit(PIECES))), "")
        return F.struct(F.element_at(p, i).alias("value"), F.substring(before, -WINDOW, WINDOW).alias("before"), F.array_join(F.slice(p, i + 1, F.lit(3)), "").substr(1, 64).alias("after"))

    hits = F.when(n > 2, F.transform(F.sequence(F.lit(2), n, F.lit(2)), around))
    # outer, as the inner one would work the pattern out twice, once for a filter
    rows = pieces.select("doc_id", "source", F.posexplode_outer(hits).alias("place", "hit")).where("hit IS NOT NULL")
    return rows.select("doc_id", "source", "place", "hit.value", F.regexp_extract("hit.before", BEFORE, 0).alias("before"), F.regexp_extract("hit.after", AFTER, 0).alias("after"), F.regexp_extract("hit.after", NEXT, 0).alias("next"))


def described(found: DataFrame) -> DataFrame:
    """found with one numeric column for each of FEATURES."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    changes = F.regexp_count(v, F.lit(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"))
    columns = {
        "chars": F.least(n, F.lit(200)),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.sqrt(n),
        "hex": F.when(v.rlike("^[0-9a-fA-F]+$"), 1.0).otherwise(0.0),
        "changes": changes / n, "vowels": share("[aeiouAEIOU]"),
        "covered": F.lit(1.0) - F.length(F.regexp_replace(v, DICTIONARY, "")) / n,
        "credential": F.when(F.col("before").rlike(CREDENTIAL), 1.0).otherwise(0.0),
        "lookalike": F.when(F.col("before").rlike(LOOKALIKE), 1.0).otherwise(0.0),
        "assigned": F.when(F.col("before").rlike(r"[=:]\s*[\"'`]?$"), 1.0).otherwise(0.0),
        "quoted": F.when(F.col("before").rlike("[\"'`]$"), 1.0).otherwise(0.0),
        "prefix": F.when(v.rlike(r"^(AKIA|ASIA|ghp_|gho_|glpat-|sk-|sk_live_|xox[abp]-|eyJ|AIza|npm_)"), 1.0).otherwise(0.0),
        "uuid": F.when(v.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), 1.0).otherwise(0.0),
        "in_url": F.when(F.col("before").rlike("://[^\\s/:@]+:$"), 1.0).otherwise(0.0),
        "closed": F.when(F.col("after").rlike("^[\"'`;@]"), 1.0).otherwise(0.0),
        "word_after": F.when(F.col("next").rlike(r"(?i)^[.,]?[ \t]+(is|was|are|and|or|of|the|to|in|for|if|must|und|der|die|el|la|de|et)\b"), 1.0).otherwise(0.0),
        "plain": F.when(v.rlike("^([A-Z]?[a-z]+|[A-Z]+)([_-]([A-Za-z][a-z]*))*$"), F.least(n, F.lit(40)) / 40.0).otherwise(0.0),
        "path_test": F.when(F.col("source").rlike("(?i)(test|example|fixture|sample|mock|docs?/)"), 1.0).otherwise(0.0),
    }
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """source, before, value, after, next, label: findings made by rule; every value comes from hashes of its row number."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = F.translate(F.regexp_replace(F.base64(F.unhex(digest("b"))), "=", ""), "+/", "Qz")
    h, pick = digest("a"), lambda *c: F.element_at(F.array(*map(F.lit, c)), (F.pmod(F.xxhash64("id", F.lit(len(c))), F.lit(len(c))) + 1).cast("int"))
    size = lambda lo, hi: (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(hi - lo + 1)) + lo).cast("int")
    cut = lambda c, n: F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    named = F.concat(pick("token", "secret", "password", "api_key", "access_key", "auth_token", "API_KEY", "TOKEN", "clientSecret", "private_key"), pick(" = \"", "=\"", ": \"", " = '", "=", ": "))
    words = F.concat(pick("of the ", "see also ", "in und ", "la casa ", "les deux ", "thing and "), pick("", "", "(", "#"))
    digests = F.concat(pick("commit ", "sha256:", "md5 ", "checksum: ", "digest=", "revision ", "etag: \"", "build "))
    word_run = F.concat(pick("image", "article", "content", "index", "newspage", "userlist"), pick("-of-the-", "_with_", "-and-", "/list/"), pick("item", "table", "homepage", "example"), F.lit("-"), (F.col("id") + 100).cast("string"))
    upper = F.upper(cut(F.translate(h, "0123456789abcdef", "QWERTYUIOP23456Z"), 16))
    kinds = [
        (named, cut(h, 40), 1), (named, cut(h, size(24, 64)), 1), (named, cut(b64, size(20, 42)), 1), (F.concat(named), F.upper(cut(h, size(32, 40))), 1),
        (F.concat(pick("key ", "aws ", "use ", "")), F.concat(F.lit("AKIA"), upper), 1),
        (F.concat(pick("", "login ", "with ")), F.concat(pick("ghp_", "sk-", "glpat-", "sk_live_"), cut(b64, 36)), 1),
        (words, cut(h, 16), 0), (words, cut(h, size(16, 40)), 0), (digests, cut(h, pick(32, 40, 64)), 0), (digests, cut(h, size(16, 40)), 0),
        (F.concat(pick("id: ", "uuid=", "the ", "id=\"")), F.concat_ws("-", cut(h, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), 0),
        (F.concat(pick("see ", "href=\"", "file ", "the ", "path: ")), word_run, 0), (words, F.concat(pick("2024-01-", "+49-30-", "1000-2000-"), cut(F.translate(h, "abcdef", "123456"), 12)), 0),
        (F.concat(pick("base64,", "order ", "the ", "serial: ")), cut(b64, size(20, 42)), 0), (words, F.concat(pick("mail", "name", "user"), F.lit("."), cut(F.translate(h, "abcdef", "123456"), 8), F.lit(".example.com")), 0),
        (named, F.concat(pick("example", "your-token-here-", "test-value-"), pick("0123456789", "1234", "00000000")), 0),
        (named, F.concat(pick("hunter", "Winter", "dragon", "qwe", "Tr0ub", "s3cur"), cut(h, size(1, 4)), pick("!", "#", "@", "-", "", "$"), cut(b64, size(2, 6))), 1),
        (named, F.concat(pick("Correct", "p@ssw0rd", "My", "Blue", "Pa55", "Secret"), pick("-", "", "_", "."), pick("Long", "Horse", "Secret", "Word", "Key"), pick("!", "#", "@", "-", "*"), cut(h, size(2, 5))), 1),
        (named, cut(F.translate(h, "0123456789", "ghijklmnop"), size(18, 32)), 1), (named, cut(b64, size(10, 16)), 1),
        (F.concat(pick("postgres", "mysql", "redis", "https", "amqp"), F.lit("://"), pick("user:", "admin:", "app:", "root:")), F.concat(cut(b64, size(4, 14)), pick("", "!", "#", "1")), 1),
        (named, pick("required", "optional", "password", "undefined", "nothing", "missing", "invalid", "changed", "expired", "something", "in-the-vault", "not_set", "getpass", "request"), 0),
        (F.concat(pick("password: ", "the secret: ", "token: ", "Passwort: ", "secret=")), pick("between", "because", "please", "between_us", "always", "whatever", "everyone", "nobody", "patience", "practice"), 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    of = lambda k: reduce(lambda c, i: c.when(kind == i, kinds[i][k] if k < 2 else F.lit(kinds[i][2])), range(1, len(kinds)), F.when(kind == 0, kinds[0][k] if k < 2 else F.lit(kinds[0][2])))
    made = spark.range(0, rows, 1, 4).select(pick("src/app", "web", "src3", "crawl", "").alias("source"), F.concat(pick("", "and ", "la de ", "x. "), of(0)).alias("before"), of(1).alias("value"), F.when(of(1).rlike("^[a-z_-]+$") & (of(2) == 0), pick(" and then", " is the", ".", " of the", "", "\"")).when(of(0).contains("://"), F.lit("@db.host/x")).otherwise(pick("\"", "", "'", ".", " and so", ";")).alias("next"), of(2).cast("double").alias("label"))
    return made.withColumn("after", F.regexp_extract("next", AFTER, 0))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(rows))


def train(findings: DataFrame, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from findings(source, before, value, after, next, label)."""
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=3).fit(_vectors(findings).select("features", "label"))


def scored_candidates(docs: DataFrame, model: RandomForestClassificationModel, source: Column) -> DataFrame:
    """doc_id, place, value, source, score: every candidate with the forest's probability that it is a secret."""
    found = model.transform(_vectors(candidates(docs, source)))
    return found.select("doc_id", "place", "value", "source", F.round(vector_to_array("probability")[1], 6).alias("score"))


def findings(docs: DataFrame, source: Column, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """The candidates that the forest takes for secrets."""
    model = model or train(labelled_findings(docs.sparkSession))
    return scored_candidates(docs, model, source).where(F.col("score") >= THRESHOLD)


def redacted(docs: DataFrame, source: Column, model: RandomForestClassificationModel | None = None, mark: str = "<secret>") -> DataFrame:
    """docs with every finding's value replaced in its text; no document goes. Columns as in docs, n_chars made anew
    where there is one. Only documents with findings are joined, by id and text hash."""
    # names of its own, apart from any that docs may have
    key, values = "__text_hash", "__secret_values"
    out = docs.withColumn(key, F.xxhash64("text"))
    named = out.select(F.struct(F.col("doc_id").alias("i"), F.col(key).alias("k")).alias("doc_id"), source.cast("string").alias("source"), "text")
    found = findings(named, F.col("source"), model)
    gathered = found.groupBy(F.col("doc_id.i").alias("__i"), F.col("doc_id.k").alias("__k")).agg(F.collect_set("value").alias(values))
    # texts stay where they are while the findings' measured size lets them go to all tasks
    gathered = written(gathered, "secrets")
    size = gathered.agg(F.sum(F.aggregate(values, F.lit(64).cast("long"), lambda n, v: n + F.length(v) * 2 + 32))).first()[0] or 0
    joined = out.join(F.broadcast(gathered) if size <= BROADCAST_BYTES else gathered, out["doc_id"].eqNullSafe(gathered["__i"]) & (out[key] == gathered["__k"]), "left")
    longest_first = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    text = F.when(F.col(values).isNull(), F.col("text")).otherwise(F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark))))
    made = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*(made.get(c, out[c]).alias(c) for c in docs.columns))
