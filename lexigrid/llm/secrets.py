"""Secret scans: candidates by pattern, false positives removed by a random forest, all in DataFrame operations.

A candidate is a run of at least ``SHORTEST`` token characters with a digit; a run of any length that starts as known
secrets do; what is assigned to a name with a telling word, of any length and characters; or a private-key block, which
needs no forest.  Features: length, shares of character classes, class changes and common letter pairs between
neighbours, the share covered by dictionary words, the path the text comes from and paths inside the candidate, and the
words before and after it.  The forest is fitted by Spark ML on labelled findings and then written out as SQL, so that scanning is one
projection over each row: no shuffle, no join, nothing but the row in memory.

The labelled findings come from a seeded generator of real-looking secrets and of what is taken for secrets: commit
ids, checksums, identifiers, paths, versions, placeholders, numbers, addresses.  Own findings can be given instead, as a
list or as a table (c, b, a, p, label): candidate, words before and after, path, and 1 for a secret.
"""

from __future__ import annotations

import json
import random
import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import free_prefix, table

SHORTEST, THRESHOLD, MASK = 16, 0.5, "[SECRET]"
#: The bounded training set, the number of trees and their depth.
FINDINGS, TREES, DEPTH = 4000, 20, 7
# Words of the dictionary feature, common letter pairs, known beginnings of secrets, words before them.
DICTIONARY = (
    "about access account action active admin after again align array async author auto back base before block body "
    "book border build button cache call case center change check class click client code color column common config "
    "connect content control copy core count create current data date default delete demo dev device display document "
    "domain down edit element email enable end error event example export false field file filter final find first "
    "font form format free from function get global group handler have head height help hidden home host icon image "
    "import index info init inner input insert install integer into item json key label language last layout left "
    "length level library license line link list load local lock login main make manager many map margin mark master "
    "max media menu message method mode model module more mouse move name native network new next node none note null "
    "number object offset only open option order other output over package padding page panel param parent part pass "
    "password path photo place plugin point position post print private process product profile project property "
    "public query random range read record remove render replace report request reset resource response result right "
    "root route row run sample save scale screen script scroll search section select self send server service session "
    "set shadow share show side simple site size sort source space start state static status step stop store string "
    "style submit success support switch system table target task template test text that the this thread time title "
    "token tool top total tree true type under unit update upload user value version video view void wait watch web "
    "when widget width window with word work world write your"
)
LETTER_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce"
PREFIXES = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(live|test)_|sk-|eyJ|AIza|ya29[.]|SG[.]|npm_|pypi-)"
#: Words of phrases people use as passwords, for the generator only.
PHRASE = (
    "correct horse battery staple orbit lemon velvet tiger marble canyon pickle walnut rocket saddle thunder maple copper "
    "puzzle falcon garlic ribbon anchor breeze cactus dragon ember fossil goblin hammer iguana jungle kettle lantern magnet "
    "nectar oyster pepper quartz raven shovel turnip umbrella violin whisper yogurt zebra monkey summer winter hunter purple"
)
TELLING = "key|token|secret|passw|pwd|auth|bearer|credential|api|private|access"
HARMLESS = "sha[0-9]|sha\\\\b|commit|hash|checksum|uuid|digest|md5|revision|version|isbn|doi|session|build|etag|\\\\bid\\\\b|http|www|@|order|phone|tel"
MOCK_PATH = "test|example|sample|mock|fixture|demo"
_RUN = "([A-Za-z0-9+/_.-]{%d,}={0,2})" % SHORTEST
# Groups repeat possessively, which Java does in a loop; else long texts overflow its stack.
_KNOWN = "(?<![A-Za-z0-9])" + PREFIXES[1:] + "[A-Za-z0-9+/_.-]*={0,2}"
_NAME = r"(?i:%s)[A-Za-z0-9_.-]*+[\"'`\])\\]*+\s*+(?::\s*[A-Za-z_][A-Za-z0-9_.\[\]]*+\s+=(?!=)|:=|=>|={1,3}|:)" % TELLING
_END = r"[&,;][A-Za-z_][A-Za-z0-9_.-]*+=|[\"'`][,;:)}\]>\s]|</|<br|(?i:%s)[A-Za-z0-9_.-]*+[\"'`\])\\]*+[:=]|\s|\z" % TELLING
_QUOTED = r"(\"{3}|'{3}|\\?[\"'`])(?:(?!\3)(?:\\.|[^\r\n]))*+\3"
#: Group 1 is the name and the assignment, group 2 the value, group 4 the two words after it.  The latter two are only
#: looked at: another name may stand in them.
_ASSIGNED = rf"((?:{_NAME}|\b(?i:bearer|basic)(?=\s))\s*+(?:[bru]{{1,2}}(?=[\"']))?+)(?=({_QUOTED}|\S+?(?={_END}))[\"'`,;:)\]}}>]*+((?:[ \t]*+[^\s]++){{0,2}}+))"
#: What is taken off the end of a value without quotes.
STRIPPED = "\"'`,;:)]}>.\\"
_BEGIN, _CLOSE = (f"-----{x}[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
_GAP = r"(?:[\s\"'+>]|\\[nrt])"
# headers such as DEK-Info stand on a line each, or one after the other where line ends were lost
_HEADERS = r"(?:[A-Za-z][A-Za-z0-9-]*+:(?:(?:(?!-----)[^\r\n\\])*+(?:[\r\n]|\\[nr])|[ \t]*+[^\s\\]++(?:[ \t]++\(?[Vv]?[0-9.(][^\s-]*+)*+\s)%s*+)*+" % _GAP
_LAST = r"(?:[A-Za-z0-9+/]*+={1,2}(?![A-Za-z0-9=])|=[A-Za-z0-9+/]{4}(?![A-Za-z0-9+/])|[A-Za-z0-9+/]++(?=\s*+\z))"
_LINES = rf"(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_GAP}++{_LAST})?|{_LAST})"
#: A block to its end line, or one that was cut off, as far as its lines go.
_PEM = rf"{_BEGIN}(?:{_GAP}*+{_HEADERS}[A-Za-z0-9+/=\s\\\"'>]++{_CLOSE}|{_GAP}*+{_HEADERS}{_LINES})"


def _lit(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"



def _feature_sql() -> dict[str, str]:
    """SQL of each feature of a candidate x.c after the words x.b, from a text at the path x.p."""
    n = "length(x.c)"
    words = "|".join(sorted((w for w in DICTIONARY.split() if len(w) > 3), key=lambda w: (-len(w), w)))
    pairs = "|".join(LETTER_PAIRS.split())
    return {
        "len": n,
        "digits": f"regexp_count(x.c, '[0-9]') / {n}",
        "upper": f"regexp_count(x.c, '[A-Z]') / {n}",
        "lower": f"regexp_count(x.c, '[a-z]') / {n}",
        "hex": "cast(x.c rlike '^([0-9a-f]+|[0-9A-F]+)$' as int)",
        "uuid": "cast(lower(x.c) rlike '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-' as int)",
        "changes": f"regexp_count(x.c, '[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[+/_.=-](?=[A-Za-z0-9])') / {n}",
        "pairs": f"regexp_count(lower(x.c), '(?={pairs})') / {n}",
        "distinct": "size(array_distinct(split(x.c, '')))",
        "words": f"1 - length(regexp_replace(lower(x.c), '{words}', '')) / {n}",
        "filler": "cast(lower(x.c) rlike '(.)\\\\1{4}|12345|abcdef|example|your|dummy|changeme|placeholder' as int)",
        "slashes": "regexp_count(x.c, '/')",
        "dots": "regexp_count(x.c, '[.]')",
        "joins": "regexp_count(x.c, '[_-]')",
        "known": f"cast(x.c rlike '{PREFIXES}' as int)",
        "telling": f"regexp_count(x.b, '{TELLING}')",
        "harmless": f"regexp_count(x.b, '{HARMLESS}')",
        "assigned": "cast(x.b rlike '[=:][^A-Za-z0-9]*$' as int)",
        "after": f"regexp_count(x.a, '{HARMLESS}')",
        "code_after": f"cast(x.a rlike {_lit('^[^a-z0-9]*[(' + chr(92) + '[]|^[.][a-z]')} as int)",
        "mock": f"regexp_count(lower(x.p), '{MOCK_PATH}')",
        "quoted": f"cast(x.b rlike {_lit(chr(91) + chr(34) + chr(39) + chr(96) + ']$')} as int)",
        "signs": f"regexp_count(x.c, {_lit('[^A-Za-z0-9+/_.= -]')}) / {n}",
        "spaces": f"regexp_count(x.c, {_lit(chr(92) + 's')})",
        "code": f"regexp_count(x.c, {_lit('[({<' + chr(92) + '[]|[$%][A-Za-z{(]|[*]{3}|::|->|://')})",
    }


FEATURES = _feature_sql()


def labelled_findings(n: int = FINDINGS, seed: int = 3) -> list[dict]:
    """Findings {c, b, a, p, label}: candidate, words before and after it, path, and 1 for a secret."""
    r = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    word = lambda: pick("etaoinshrdlucmf", r.randint(2, 9))
    dictionary = DICTIONARY.split()

    def secret() -> tuple[str, str]:
        c = r.choice(
            [
                lambda: pick("0123456789abcdef", r.choice([32, 40, 40, 48, 64])),
                lambda: pick("0123456789ABCDEF", r.choice([32, 40, 64])),
                lambda: pick(alnum + "+/", r.choice([24, 32, 40, 43, 64])) + r.choice(["", "=", "=="]),
                lambda: pick(alnum, r.randint(20, 48)),
                lambda: pick(alnum + "-_", r.randint(20, 48)),
                lambda: r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16),
                lambda: r.choice(["ghp_", "gho_", "glpat-", "npm_", "sk_live_", "rk_live_", "sk-", "AIza"]) + pick(alnum, 36),
                lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
                lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum + "-_", 60) + "." + pick(alnum + "-_", 43),
            ]
        )()
        name = r.choice(
            ["token", "api_key", "secret", "apikey", "password", "access_token", "auth", "client_secret", "private_key",
             "aws_secret_access_key", "bearer", "credentials", "passwd", "TOKEN".lower(), "key"]
        )
        mark = r.choice([" = ", ' = "', "=", '="', ": ", ": '", ":", " "])
        return c, f"{word()} {name}{mark}"

    def harmless() -> tuple[str, str]:
        before = f"{word()} {word()} "
        return r.choice(
            [
                lambda: (pick("0123456789abcdef", 40), r.choice(["commit ", "revision ", "git sha1 ", "in commit "])),
                lambda: (pick("0123456789abcdef", r.choice([32, 40, 64])), r.choice(["md5 ", "sha256: ", "checksum = ", "hash: ", "etag: ", "digest "])),
                lambda: (pick("0123456789abcdef", r.choice([32, 40, 64])), before),
                lambda: ("-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), r.choice([before, "id: ", "session id = ", "uuid "])),
                lambda: (pick(string.digits, r.randint(16, 20)), r.choice([before, "order ", "card ", "phone: "])),
                lambda: ("_".join(r.choices(dictionary, k=r.randint(3, 5))) + str(r.randint(0, 99)), before),
                lambda: ("".join(w.capitalize() for w in r.choices(dictionary, k=r.randint(3, 5))) + str(r.randint(0, 9)), before),
                lambda: ("/".join(r.choices(dictionary, k=r.randint(3, 6))) + "/" + str(r.randint(1, 2030)), r.choice(["https:", before, "see http:"])),
                lambda: (".".join(r.choices(dictionary, k=3)) + ".example" + str(r.randint(1, 9)) + ".com", r.choice([f"{word()}@", before, "http://"])),
                lambda: ("mail" + str(r.randint(1, 9)) + ".example.com", f"{word()}.{r.randint(0, 99)}@"),
                lambda: (f"{r.randint(0, 30)}.{r.randint(0, 99)}.{r.randint(0, 999)}-" + r.choice(dictionary) + str(r.randint(1, 9)) + "-snapshot", "version "),
                lambda: (r.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxxxxxxxxx1", "EXAMPLE1234567890ABCDEF", "0000000000000000000000", "changeme1234567890", "abcdef0123456789abcdef"]), f"{word()} {r.choice(['api_key', 'token', 'secret'])} = "),
                lambda: (word() * 2 + word() + word() + pick(string.digits, 2) + "aaaa", before),
                lambda: (f"2{r.randint(100, 999)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.00", before),
            ]
        )()

    phrase, signs = PHRASE.split(), "!@#$%^&*?+~"
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "auth", "key", "credential", "access_key", "private_key"]
    leet = str.maketrans("aeiost", "43105+")

    def assigned(quoted: bool) -> str:
        return r.choice(names) + r.choice(["", "", '"' if quoted else ""]) + r.choice([" = ", "=", ": ", ":", " := "]) + (r.choice("\"'") if quoted else "")

    def password() -> tuple[str, str]:
        """A secret that is known by what it is assigned to, or by how it starts."""
        quoted = r.random() < 0.5
        w = lambda: r.choice(phrase) if r.random() < 0.8 else word()
        c = r.choice(
            [
                lambda: w() + pick(string.digits, r.randint(1, 4)) + r.choice(["", w(), r.choice(signs)]),
                lambda: w().capitalize() + pick(string.digits, r.randint(1, 4)) + r.choice(["", pick(signs, r.randint(1, 2))]),
                lambda: w().capitalize().translate(leet) + r.choice(signs) + pick(string.digits, 1) + pick(alnum + signs, r.randint(1, 4)),
                lambda: w().translate(leet) + pick(signs + string.digits, r.randint(1, 3)),
                lambda: r.choice(["-", "_", "-", " " if quoted else "-"]).join(w() for _ in range(r.randint(3, 5))),
                lambda: pick(alnum, r.randint(8, 20)),
                lambda: pick(alnum + signs, r.randint(8, 24)),
                lambda: pick(string.ascii_letters, r.randint(10, 40)),
                lambda: pick(string.ascii_letters + signs, r.randint(8, 24)),
                lambda: pick(string.ascii_lowercase, r.randint(12, 32)),
                lambda: pick("0123456789abcdef", r.randint(10, 24)),
            ]
        )()
        if r.random() < 0.12:
            c = r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase, 16)
            return c, r.choice([f"{word()} {word()} ", f"{word()} key ", assigned(False)])
        return c, assigned(quoted)

    def plain() -> tuple[str, str]:
        """What is assigned to such names and is no secret."""
        quoted = r.random() < 0.5
        some = lambda a, b: r.choices(dictionary, k=r.randint(a, b))
        one = lambda: r.choice(dictionary + phrase)
        c = r.choice(
            [
                lambda: r.choice(["none", "null", "true", "false", "undefined", "required", "optional", "string", "str", "int", "bytes", "nil", "default", "redacted", "secret", "disabled"]),
                lambda: one(),
                lambda: one().capitalize(),
                lambda: word() if r.random() < 0.5 else word().capitalize(),
                lambda: r.choice("-_.").join(some(2, 4)),
                lambda: "".join(w.capitalize() for w in some(2, 4)),
                lambda: " ".join(some(3, 9)) if quoted else one() + r.choice(["s", "ed", "ing"]),
                lambda: pick(string.digits, r.randint(1, 7)) + r.choice(["", "", ".5", "px", "%", "ms"]),
                lambda: f"2{r.randint(100, 999)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
                lambda: pick(alnum + signs, r.randint(1, 4)),
                lambda: r.choice(["os.environ[", "getenv(", "config.get(", "request.form[", "self.", "get_token(", "vault.read(", "settings."]) + r.choice(["'", ""]) + r.choice([str.upper, str])("_".join(some(1, 2))) + r.choice(["", "')", "']"]),
                lambda: r.choice([".", "_", ".", "::", "->"]).join(some(1, 3)) + r.choice("([") + r.choice(["'", '"', ""]) + r.choice([str.upper, str])(r.choice("_-").join(some(1, 3))) + r.choice(["", "')", "']", ")"]),
                lambda: r.choice(["${%s}", "$(%s)", "{{ %s }}", "$%s", "<%s>", "%%(%s)s", "{%s}", "[%s]"]) % "_".join(some(1, 3)).upper(),
                lambda: r.choice(["******", "***", "...", "xxxxxxxx", "changeme", "your_password_here", "your-token", "example", "<your-key>", "placeholder", "dummy_value"]),
                lambda: r.choice(["https://", "http://", "/", "./"]) + "/".join(some(2, 4)) + r.choice(["", ".pem", ".html", ".json"]),
            ]
        )()
        if r.random() < 0.05:
            return r.choice(["sk-", "npm_", "gho_"]) + r.choice(["-", "_"]).join(some(1, 3)), f"{word()} {word()} "
        return c if quoted else (c.rstrip(STRIPPED).split() or [c])[0], assigned(quoted)

    out = []
    for i in range(n):
        if r.random() < 0.4:
            c, b = password() if i % 2 else plain()
        else:
            c, b = secret() if i % 2 else harmless()
        quote = b[-1] if b[-1:] in ("'", '"') else ""
        common = [lambda: "", lambda: f" {word()} {word()}", lambda: f" {word()}"]
        telling = [lambda: " is the " + r.choice(["hash", "checksum", "commit", "digest", "revision"]), lambda: f" {r.choice(['sha256', 'md5', 'commit', 'build', 'order'])} {word()}"]
        a = quote + r.choice(common * 3 + telling if i % 2 == 0 else common)()
        path = f"{word()}/{word()}.{r.choice(['py', 'txt', 'md', 'html'])}"
        label, mocked = i % 2, r.random() < 0.06
        if mocked:  # findings in mock data are not secrets
            path, label = r.choice(["tests/", "examples/", "fixtures/mock_", "sample/"]) + path, 0
        out.append({"c": c, "b": b.lower(), "a": a.lower(), "p": path if r.random() < 0.7 or mocked else "", "label": label})
    return out


def _tree_sql(node) -> str:
    """A fitted tree as SQL over the struct f of features: the share of secrets in the leaf."""
    if node.subtreeDepth() == 0:
        stats = node.impurityStats().stats()
        return f"{stats[1] / max(1e-9, stats[0] + stats[1]):.6f}D"
    split = node.split()
    name = list(FEATURES)[split.featureIndex()]
    return f"if(f.{name} <= {split.threshold()!r}D, {_tree_sql(node.leftChild())}, {_tree_sql(node.rightChild())})"


def _features(x: str = "x") -> str:
    return "named_struct(" + ", ".join(f"'{k}', cast({v.replace('x.', x + '.')} as double)" for k, v in FEATURES.items()) + ")"


def findings_table(spark: SparkSession, findings: list[dict] | DataFrame) -> DataFrame:
    """(label, f, features) of labelled findings; missing words and paths are empty, findings without a label are left out."""
    if isinstance(findings, DataFrame):
        rows = findings
    else:
        kinds = "array<struct<c:string,b:string,a:string,p:string,label:int>>"
        rows = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(findings)), kinds)))
    rows = rows.where("c is not null and c <> '' and label in (0, 1)")
    text = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("c", "b", "a", "p")]
    rows = rows.select(F.struct(*text).alias("x"), F.col("label").cast("double").alias("label"))
    rows = rows.select("label", F.expr(_features()).alias("f")).select("label", "f", "f.*")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "f", "features")


def fit_model(spark: SparkSession, findings: list[dict] | DataFrame, seed: int = 3):
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=3).fit(findings_table(spark, findings))


def fit_forest(spark: SparkSession, findings: list[dict] | DataFrame, seed: int = 3) -> str:
    """SQL of the probability that a candidate with features f is a secret."""
    return forest_as_sql(fit_model(spark, findings, seed))


def forest_as_sql(forest) -> str:
    trees = [_tree_sql(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in forest.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}"


_forests: dict[str, str] = {}


def forest_sql(spark: SparkSession, findings: list[dict] | DataFrame | None = None) -> str:
    """The forest, fitted once a driver for the built-in findings."""
    if findings is not None:
        return fit_forest(spark, findings)
    if "own" not in _forests:
        _forests["own"] = fit_forest(spark, labelled_findings())
    return _forests["own"]


def with_findings(docs: DataFrame, forest: str, text_col: str = "text", path_col: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with columns for the text, its candidates array<struct<c, b, a, p>> and secrets array<string>, and their prefix.

    The columns are <prefix>t, <prefix>candidates and <prefix>secrets; secrets stand longest first.
    """
    p = free_prefix(docs)
    path = f"coalesce(cast(`{path_col}` as string), '')" if path_col else "''"
    words = docs.withColumn(f"{p}t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = words.withColumn(f"{p}w", F.split(f"{p}t", r"\s+"))
    hot = f"filter(sequence(0, size({p}w) - 1), i -> length({p}w[i]) >= {SHORTEST} and {p}w[i] rlike '[0-9]')"
    words = words.withColumn(f"{p}hot", F.expr(hot))
    # each candidate with what stands before it: two words, and the part of its own word
    before = f"lower(concat_ws(' ', get({p}w, i - 2), get({p}w, i - 1), substring_index({p}w[i], c, 1)))"
    after = f"lower(concat_ws(' ', substring({p}w[i], locate(c, {p}w[i]) + length(c)), get({p}w, i + 1), get({p}w, i + 2)))"
    found = f"""filter(flatten(transform({p}hot, i -> transform(
        regexp_extract_all({p}w[i], '{_RUN}', 1),
        c -> named_struct('c', regexp_replace(c, '^[./-]+|[./-]+$', ''), 'b', {before}, 'a', {after}, 'p', {path})))),
        x -> length(x.c) >= {SHORTEST} and x.c rlike '[0-9]')"""
    none = "cast(array() as array<struct<c:string,b:string,a:string,p:string>>)"
    words = words.withColumn(f"{p}runs", F.expr(f"if(size({p}hot) = 0, {none}, {found})"))
    known = f"""flatten(transform(filter(sequence(0, size({p}w) - 1), i -> {p}w[i] rlike {_lit(_KNOWN)}), i -> transform(
        regexp_extract_all({p}w[i], {_lit(_KNOWN)}, 0),
        c -> named_struct('c', regexp_replace(c, '[./-]+$', ''), 'b', {before}, 'a', {after}, 'p', {path}))))"""
    words = words.withColumn(f"{p}known", F.expr(f"if({p}t rlike {_lit(_KNOWN)}, {known}, {none})"))
    # the name with the assignment and its quote, and the value without quotes and what closes a phrase
    quote, closed = _lit(r"^(\"{3}|'{3}|\\?[\"'`])"), _lit(r"(?s)^(\"{3}|'{3}|\\?[\"'`])(.*)\1$")
    bare = f"regexp_replace(regexp_replace(v, {_lit(r'^[\"' + chr(39) + '`]+')}, ''), {_lit(r'[\"' + chr(39) + r'`,;:)\]}>.\\]+$')}, '')"
    value = f"if(v rlike {closed}, regexp_replace(v, {closed}, '$2'), {bare})"
    parts = ", ".join(f"regexp_extract_all({p}t, {_lit(_ASSIGNED)}, {i})" for i in (1, 2, 4))
    own = value.replace("v,", "z['1'],").replace("v rlike", "z['1'] rlike")
    given = f"""transform(arrays_zip({parts}), z -> named_struct('c', {own},
        'b', lower(concat(z['0'], regexp_extract(z['1'], {quote}, 1))), 'a', lower(z['2']), 'p', {path}))"""
    words = words.withColumn(f"{p}given", F.expr(f"if({p}t rlike {_lit(_ASSIGNED)}, {given}, {none})"))
    more = f"array_distinct(filter(concat({p}known, {p}given), x -> not contains('{MASK}', x.c) and not exists({p}runs, y -> y.c = x.c)))"
    out = words.withColumn(f"{p}candidates", F.expr(f"if(size({p}known) + size({p}given) = 0, {p}runs, concat({p}runs, {more}))"))
    out = out.withColumn(f"{p}scored", F.expr(f"transform({p}candidates, x -> named_struct('c', x.c, 'f', {_features()}))"))
    picked = f"transform(filter({p}scored, y -> {forest.replace('f.', 'y.f.')} >= {THRESHOLD}), y -> y.c)"
    keys = f"if(contains({p}t, 'PRIVATE KEY'), regexp_extract_all({p}t, {_lit(_PEM)}, 0), cast(array() as array<string>))"
    longest = "(a, b) -> case when length(a) > length(b) then -1 when length(a) < length(b) then 1 when a < b then -1 when a > b then 1 else 0 end"
    out = out.withColumn(f"{p}all", F.expr(f"array_sort(array_distinct(concat({keys}, {picked})), {longest})"))
    # what stands only inside longer secrets is no secret of its own
    start = f"named_struct('t', {p}t, 's', cast(array() as array<string>))"
    fold = f"(y, s) -> if(contains(y.t, s), named_struct('t', replace(y.t, s, '{MASK}'), 's', concat(y.s, array(s))), y)"
    out = out.withColumn(f"{p}secrets", F.expr(f"aggregate({p}all, {start}, {fold}, y -> y.s)"))
    return out, p


def _redacted(p: str) -> str:
    return f"aggregate({p}secrets, {p}t, (t, s) -> replace(t, s, '{MASK}'))"


def scan(docs: DataFrame, findings: list[dict] | DataFrame | None = None, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, n_candidates, secrets, redacted) for each row of ``docs``.

    Null and empty texts have no candidate and an empty redacted text; texts of any length are read whole; a repeated
    secret counts once a document; a candidate exactly at the threshold is a secret; repeated rows stay repeated; an empty
    table gives an empty result; columns but those named are ignored.
    """
    keep = [F.col("doc_id"), F.col(text_col).alias("text")] + ([F.col(path_col).alias("path")] if path_col else [])
    out, p = with_findings(docs.select(*keep), forest_sql(docs.sparkSession, findings), "text", "path" if path_col else None)
    return out.selectExpr("doc_id", f"cast(size({p}candidates) as bigint) as n_candidates", f"{p}secrets as secrets", f"{_redacted(p)} as redacted")


def redact(docs: DataFrame, findings: list[dict] | DataFrame | None = None, path_col: str | None = None) -> DataFrame:
    """``docs`` with every secret masked in ``text``, null texts kept, and ``n_chars``, if there, counted anew."""
    out, p = with_findings(docs, forest_sql(docs.sparkSession, findings), "text", path_col)
    out = out.withColumn("text", F.expr(f"if(text is null, null, {_redacted(p)})"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(f"{p}secrets") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its candidates, its secrets and the digest of what is left.  Odd rows as in scan."""
    out = scan(table(spark, sf_dir, "documents"), path_col="source")
    return out.selectExpr(
        "doc_id", "n_candidates", "cast(size(secrets) as bigint) as n_secrets", "sha2(redacted, 256) as redacted_sha256", "secrets"
    )
