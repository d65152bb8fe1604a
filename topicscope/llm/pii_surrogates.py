"""PII surrogates: keyed, type-consistent replacements [DataFrame functions only].

1. Entities are found with one linear-time pattern; each has parts: a canonical
   value (e.g. the digits of a phone number whatever its punctuation) with a
   kind.  A person is a given name (by gender) and a family name.
2. The distinct parts of the whole table get a surrogate each: a function of
   the key, the kind, the value and an attempt number that keeps the kind's
   format (digits, letter case, script, gender ending, Luhn check digit).
3. Collision check: within a kind no two values may share a surrogate and no
   surrogate may be a value of the table.  Losers take the next attempt until
   none is left, so distinct values stay distinct; a value has one surrogate
   everywhere, so coreference stays.  Kinds of fixed length whose space is too
   dense for that pass values of the table round among those still open.
4. Every document gets the surrogates of its own parts and is rebuilt.  Only
   rows with an entity pass through the join.

Rebuilding joins on a key written with each row that has an entity, so a row
gets the surrogates of its own parts only, whatever its id.  A value in a third
of all documents is counted once per row before the join, which the adaptive
skew join splits.

Defined results: a null text stays null, text without an entity stays as it is
byte for byte, a null id is an id like any other, an empty table stays empty;
all other columns pass through (columns starting with ``__pii`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, stage_table

# Titles before a name, by gender.
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor")
#: Words that name a secret before ``=`` or ``:``.
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "client_secret")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SECRET_HEAD = r"(?i:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
_NAME = r"\p{Lu}[\p{L}'’]{1,40}"
_TITLE = r"(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?"
#: kind -> pattern, in order of preference at one place; none starts behind a letter or digit (see ANY).
PATTERNS = {
    "email": r"(?<![._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){1,6}",
    "secret": _SECRET_HEAD + r"[^\s\"',;]{6,}",
    "key": r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])|(?:ghp_|gho_|sk-|AIza|xox[abp]-)[A-Za-z0-9_\-]{16,})",
    "ipv4": r"(?<!\.)(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?:3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}|\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}(?:\d{1,3})?)(?![\p{L}\p{N}])",
    "phone": (r"(?<![+(])(?:(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}"
              r"|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])"),
    "person": _TITLE + r" " + _NAME + r"(?:[ \-]" + _NAME + r"){0,3}",
}
#: Heads of keys.
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "AIza", "xox")
#: What the first character must be: spares most words the longer alternatives.
STARTS = {"secret": "[" + "".join(sorted({c for w in SECRET_WORDS for c in (w[0], w[0].upper())})) + "]",
          "key": "[" + "".join(sorted({h[0] for h in KEY_HEADS})) + "]", "person": r"\p{Lu}"}
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join((f"(?={STARTS[k]})" if k in STARTS else "") + f"(?:{p})" for k, p in PATTERNS.items()) + ")"


def may_hold_entity(text: Column) -> Column:
    """Cheap and necessary: an at sign, a digit, ``=`` or ``:``, the head of a key, or a title.

    A text with none of these is not searched further.
    """
    out = text.rlike("[0-9@=:]")
    for mark in KEY_HEADS + MALE + FEMALE + NEUTRAL:
        out = out | text.contains(mark)
    return out


_GREEK, _CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыэюя"
#: Syllables and endings of invented names, by script.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge go ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi za".split(),
              {"m": "rdan lbert ndro mir rton lf rek nus".split(), "f": "nna lia rina sa tta lina mia ra".split(), "n": "ley ry lin rey sy ven nny kie".split(),
               "family": "rson ller nberg ttini mann sen dale wick".split()}),
    "cyrillic": ("ба ве га до жа за ки ла ми но пе ра са ти фа ха".split(),
                 {"m": "слав мир дор лев".split(), "f": "нна лия сия ра".split(), "n": "ша ня си ли".split(), "family": "нов ров лин ский".split()}),
    "greek": ("βα γε δι ζο κα λε μι νο πα ρε σα τι".split(),
              {"m": "νδρος λης τρος ρης".split(), "f": "ννα λια σσα ρα".split(), "n": "λη νη ρι σι".split(), "family": "πουλος ίδης άκης έας".split()}),
}


def _script(c: Column, make) -> Column:
    return (F.when(c.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(c.rlike(r"\p{IsGreek}"), make("greek"))
            .otherwise(make("latin")))


def _number(h: Column, i: Column | int) -> Column:
    """The i-th number below 256 of a hash in hex (128 digits)."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1
    return F.conv(F.substring(h, at, F.lit(2)) if isinstance(i, int) else h.substr(at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def _mask(value: Column, h: Column, keep: int = 0) -> Column:
    """Each digit and letter becomes another of its class by the hash; the first ``keep`` stay."""
    def one(ch: Column, i: Column) -> Column:
        n = _number(h, i)

        def letter(alphabet: str) -> Column:
            return F.lit(alphabet).substr((n % len(alphabet) + 1).cast("int"), F.lit(1))
        return (F.when(i < keep, ch).when(ch.rlike("[0-9]"), (n % 10).cast("string")).when(ch.rlike("[a-z]"), letter(LOWER))
                .when(ch.rlike("[A-Z]"), letter(UPPER)).when(ch.rlike(r"\p{IsCyrillic}"), letter(_CYRILLIC))
                .when(ch.rlike(r"\p{IsGreek}"), letter(_GREEK)).when(ch.rlike(r"[\p{L}\p{N}]"), letter(LOWER)).otherwise(ch))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    def term(x: Column, i: Column) -> Column:
        d = x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """Surrogate of a canonical value: keyed, of the same kind and format."""
    h = F.sha2(F.concat_ws("\x00", F.lit(key), kind, value, F.lit(str(attempt))), 512)
    more = "" if attempt < 2 else "x" * (attempt - 1)   # short formats grow when their space runs out
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    stem, tld = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.substring_index(domain, ".", -1)
    email = F.concat(_mask(F.concat(local, F.lit(more)), h), F.lit("@"), _mask(stem, F.reverse(h)), F.lit("."), tld)
    ipv4 = F.concat_ws(".", *[(_number(h, i) % 254 + 1).cast("string") for i in range(4)])
    body = _mask(F.expr("substring(__pii_value, 1, length(__pii_value) - 1)"), h, keep=1)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(luhn_sum(value) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(_mask(value, h, keep=1))

    def name(role: str) -> Column:
        def make(script: str) -> Column:
            parts, ends = SYLLABLES[script]
            inner = [_pick(parts, _number(h, i) + 256 * _number(h, i + 20)) for i in range(2 + attempt)]
            return F.concat(*inner, _pick(ends[role], _number(h, 40)))
        return _script(value, make)

    return (F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "card", card)
            .when(kind == "given_m", name("m")).when(kind == "given_f", name("f")).when(kind == "given_n", name("n"))
            .when(kind == "family", name("family")).when(kind == "phone", _mask(value, h, keep=1))
            .when(kind == "ssn", F.concat(F.lit("9"), F.expr("substring(__pii_mask, 2)")))
            .when(kind == "iban", _mask(value, h, keep=2))
            .when(kind == "key", F.concat(_mask(value, h, keep=4), F.lit(more)))
            .otherwise(F.concat(_mask(value, h), F.lit(more))))


def _with_surrogate(parts: DataFrame, key: str, attempt: int) -> DataFrame:
    h = F.sha2(F.concat_ws("\x00", F.lit(key), F.col("kind"), F.col("value"), F.lit(str(attempt))), 512)
    return (parts.withColumn("__pii_value", F.col("value")).withColumn("__pii_mask", _mask(F.col("value"), h))
            .withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, attempt))
            .select("kind", "value", "surrogate"))


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        # anchored: what stood around the entity was checked when it was found
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def parts_of(entity: Column) -> Column:
    """array<struct<kind, value>>: the canonical parts of an entity."""
    kind = kind_of(entity)
    digits, words = F.regexp_replace(entity, r"\D", ""), F.split(entity, r"[ \-]")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    role = F.when(title.isin(*MALE), F.lit("given_m")).when(title.isin(*FEMALE), F.lit("given_f")).otherwise(F.lit("given_n"))
    value = (F.when(kind == "email", lower_ascii(entity)).when(kind.isin("phone", "card", "ssn"), digits)
             .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
             .when(kind == "secret", F.regexp_replace(entity, "^" + _SECRET_HEAD, "")).otherwise(entity))
    person = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                         lambda w, i: F.struct(F.when(i == F.size(words) - 2, F.lit("family")).otherwise(role).alias("kind"),
                                               F.lower(w).alias("value")))
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def render(entity: Column, lookup: Column) -> Column:
    """The entity with its parts replaced, in its own format.  ``lookup``: map ``kind\\0value`` -> surrogate."""
    parts = parts_of(entity)
    kind = F.element_at(parts, 1)["kind"]

    def found(p: Column) -> Column:
        return F.element_at(lookup, F.concat(p["kind"], F.lit("\x00"), p["value"]))

    def cased(new: Column, old: Column) -> Column:
        return F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new))

    def fill(pattern: str) -> Column:
        start = F.struct(F.lit("").alias("o"), F.lit(1).alias("j"))

        def step(a: Column, ch: Column) -> Column:
            hit = ch.rlike(pattern)
            return F.struct(F.concat(a["o"], F.when(hit, new.substr(a["j"], F.lit(1))).otherwise(ch)).alias("o"),
                            (a["j"] + F.when(hit, 1).otherwise(0)).alias("j"))
        return F.aggregate(F.split(entity, ""), start, step, lambda a: a["o"])

    new = found(F.element_at(parts, 1))
    words = F.split(entity, r"[ \-]")
    joints = F.regexp_extract_all(entity, F.lit(r"([ \-])"), F.lit(1))
    person = F.concat(F.element_at(words, 1), F.array_join(
        F.transform(parts, lambda p, i: F.concat(F.get(joints, i), cased(found(p), F.get(words, i + 1)))), ""))
    email = F.when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(new)).otherwise(new)
    return (F.when(kind.isin("phone", "card", "ssn"), fill("[0-9]")).when(kind == "iban", fill("[0-9A-Za-z]"))
            .when(kind == "email", email).when(kind == "secret", F.concat(F.regexp_extract(entity, "^" + _SECRET_HEAD, 0), new))
            .when(kind.isin("given_m", "given_f", "given_n", "family"), person).otherwise(new))


#: Kinds whose surrogates cannot grow, and the attempt from which a value of the table may stand for another one.
FIXED, DENSE_AFTER = ("phone", "ssn", "iban", "card", "ipv4"), 6


def space_of(kind: Column, value: Column) -> Column:
    """What values of a fixed kind must share to stand for each other: length, kept head, classes of characters, Luhn check."""
    head = F.when(kind == "iban", F.substring(value, 1, 2)).when(kind.isin("phone", "card"), F.substring(value, 1, 1)).otherwise("")
    shape = F.when(kind == "ipv4", "").otherwise(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[A-Z]", "A"))
    check = F.when(kind == "card", (luhn_sum(value) % 10 == 0).cast("string")).otherwise("")
    return F.concat_ws("\x00", kind, head, shape, check)


def passed_round(pending: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate): each open value of a fixed kind gets the next open one of its space in keyed order.

    Tried surrogates are never values of the table, so none is given twice.  An
    open value alone in its space gets another value of the table there; one
    that has none there stays open (its space is all but empty).
    """
    space = space_of(F.col("kind"), F.col("value")).alias("space")
    open_ = pending.where(F.col("kind").isin(*FIXED)).select("kind", "value", space)
    ends = (own.where(F.col("kind").isin(*FIXED)).select("value", space).join(open_.select("space").distinct(), "space", "left_semi")
            .groupBy("space").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    by = Window.partitionBy("space").orderBy(F.sha2(F.concat_ws("\x00", F.lit(key), "value"), 256), "value")
    following = F.coalesce(F.lead("value").over(by), F.first("value").over(by))
    other = F.when(F.col("value") != F.col("lo"), F.col("lo")).when(F.col("value") != F.col("hi"), F.col("hi"))
    return (open_.withColumn("next", following).join(ends, "space")
            .select("kind", "value", F.when(F.col("next") != F.col("value"), F.col("next")).otherwise(other).alias("surrogate"))
            .where("surrogate is not null"))


def assign_surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), free of collisions.

    No surrogate is a value of the table, but for fixed kinds in a space so
    dense that ``DENSE_AFTER`` attempts found none free; it is never the own value.
    """
    own = parts.select("kind", F.col("value").alias("surrogate"))
    done, pending, attempt = None, parts, 0
    while True:
        trial = _with_surrogate(pending, key, attempt)
        first = trial.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = first.join(own, ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done, ["kind", "surrogate"], "left_anti")
        good = good.select("kind", "value", "surrogate")
        new = good if done is None else done.unionByName(good)
        if attempt == DENSE_AFTER:
            new = done.unionByName(passed_round(pending, parts, key)).unionByName(good.where(~F.col("kind").isin(*FIXED)))
        done = stage_table(new, "pii-surrogates")
        pending = stage_table(pending.join(done, ["kind", "value"], "left_anti"), "pii-pending")
        if pending.isEmpty():
            return done
        attempt += 1


def _free(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def replace_pii(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """``docs`` with the text's entities replaced and their number in ``count_col`` (None: no such column).

    A column of ``docs`` that has this name stays as it is, and the number's
    column takes underscores before its name.
    """
    text = F.col(text_col)
    entities = F.coalesce(F.when(may_hold_entity(text), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))),
                          F.array().cast("array<string>"))
    e, gaps, row, found, number = (_free(docs.columns, n) for n in ("pii_entities", "pii_gaps", "pii_row", "pii_map", count_col or "pii_number"))
    clean = docs.where(F.size(entities) == 0).withColumn(number, F.lit(0))
    # rows with an entity, cut at their entities: searched once, read by both steps below
    rest = [c for c in docs.columns if c != text_col]
    hit = stage_table(docs.where(F.size(entities) > 0).select(*rest, entities.alias(e), F.split(text, ANY, -1).alias(gaps),
                                                               F.monotonically_increasing_id().alias(row)), "pii-hits")
    occurs = hit.select(row, F.explode(F.flatten(F.transform(F.array_distinct(e), parts_of))).alias("p")).select(
        row, "p.kind", "p.value").distinct()
    occurs = stage_table(occurs, "pii-parts")
    table = assign_surrogates(occurs.select("kind", "value").distinct(), key)
    lookup = (occurs.join(table, ["kind", "value"])
              .groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\x00"), "value"), "surrogate"))).alias(found)))
    new = F.transform(e, lambda x: render(x, F.col(found)))
    rebuilt = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(new, lambda r, i: F.concat(r, F.get(gaps, i + 1))), ""))
    changed = hit.join(lookup, row).withColumn(text_col, rebuilt).withColumn(number, F.size(e))
    cols = [*docs.columns, *([number] if count_col else [])]
    return clean.select(*cols).unionByName(changed.select(*cols))
