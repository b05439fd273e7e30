"""Operator 2, personal data: keyed surrogates of the same type, gender, script and format. DataFrame functions only.

A text is cut by one pattern into entities and the gaps between them. An entity has a canonical form (digits alone for
numbers, lower case for addresses, names without their form of address), and its surrogate depends on the key and that form,
so one card written three ways has one surrogate written three ways. A check over all distinct entities finds surrogates
that meet (each other, or an entity that really occurs); who loses tries again until none is left, so different entities
never share a surrogate.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reckon.llm.common import cut, parquet

#: Forms of address by gender, before a name; those after one (which tell no gender in most cases).
MALE = ("Mr", "Mister", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madame", "Mme", "Mademoiselle", "Frau", "Señora", "Sra", "Señorita", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor")
AFTER_MALE, AFTER_FEMALE, AFTER = ("先生",), ("女士", "小姐"), ("さん", "様", "氏")
#: Common given names by gender; before another capitalised word they make a name without a form of address.
GIVEN_MALE = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Steven", "Paul", "Andrew", "George", "Kevin", "Brian", "Edward",
    "Peter", "Henry", "Pierre", "Jean", "Michel", "Hans", "Jürgen", "Klaus", "Wolfgang", "Carlos", "José", "Juan", "Miguel", "Pedro", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Γιώργος", "Νίκος",
)
GIVEN_FEMALE = (
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Lisa", "Nancy", "Margaret", "Emily", "Laura", "Alice", "Anna", "Emma", "Rachel", "Julia",
    "Marie", "Claire", "Sophie", "Ursula", "Sabine", "Carmen", "Lucía", "Elena", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Μαρία", "Ελένη",
)
_ADDRESS = "|".join(MALE + FEMALE + NEUTRAL)
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
_WORD = r"\p{Lu}[\p{L}'\-]+"
#: Kinds in order of precedence, with their patterns (Java).
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}",
    "secret": r"(?<=[\"'])(?=[A-Za-z_\-]{0,60}[0-9])(?=[0-9_\-]{0,60}[A-Za-z])[A-Za-z0-9_\-]{20,120}(?=[\"'])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,38}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![0-9.\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])|(?<=SSN[ :#]{1,3})[0-9]{3} ?[0-9]{2} ?[0-9]{4}(?![0-9])|(?<=ssn[ :#]{1,3})[0-9]{3} ?[0-9]{2} ?[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?![0-9]|\.[0-9])",
    "name": rf"\b(?=\p{{Lu}})(?:{_ADDRESS})\.? (?:{_WORD}(?: {_WORD}){{0,2}}|{_CJK}{{1,6}})|{_CJK}{{1,6}}(?={'|'.join(AFTER_MALE + AFTER_FEMALE + AFTER)})|\b(?=\p{{Lu}})(?:{'|'.join(GIVEN_MALE + GIVEN_FEMALE)})(?: {_WORD}){{1,2}}",
}
PATTERN = "(?:" + "|".join(KINDS.values()) + ")"
#: A cheap test that every text with an entity passes.
HINT = rf"@|[0-9][^A-Za-z]{{0,3}}[0-9]|[0-9A-Fa-f]::?[0-9A-Fa-f]|[\"'][A-Za-z0-9_\-]{{20}}|\b(?=\p{{Lu}})(?:{'|'.join(MALE + FEMALE + NEUTRAL + GIVEN_MALE + GIVEN_FEMALE)})\b|{_CJK}"
#: Scripts with the letters that their surrogate words are made of: consonants and vowels in turn, or any of the first.
SCRIPTS = {
    "IsCyrillic": ("бдгклмнпрстз", "аеиоу", "а"), "IsGreek": ("βγδκλμνπρσ", "αεηιο", "α"), "IsHan": ("山川田林森石原井上中村松竹梅高木本島谷野", None, ""), "IsHiragana": ("あいうえおかきくけこさしすせたちとなにのはまみもやゆよらりる", None, ""),
    "IsKatakana": ("アイウエオカキクケコサシスセタチトナニノハマミモヤユヨラリル", None, ""), "IsHangul": ("가나다라마바사아자차하고노도로모보소오조", None, ""), "IsArabic": ("بتجدرسعفقكلمنهي", None, ""), "IsHebrew": ("אבגדהזחטיכלמנספצקרשת", None, ""),
    "IsLatin": ("bdfgklmnprstvz", "aeiou", "a"),
}
#: Attempts after which the values of a type are taken to be used up.
MOST_ATTEMPTS = 50
#: Where the key is configured; without it a run makes one of its own.
KEY_SETTING = "spark.reckon.surrogates.key"


def _number(hex_text: Column, i: Column) -> Column:
    """Two hex digits of a hash by position, as a number 0..255; the positions go round."""
    return F.conv(F.substring(hex_text, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _places(text: Column, mark: str) -> Column:
    """For each character, how many before it match the class `mark`."""
    return F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), F.length(F.regexp_replace(F.substring(text, F.lit(1), i), f"[^{mark}]", "")).alias("k")))


def _like(text: Column, hex_text: Column) -> Column:
    """text with every ASCII digit and letter replaced by one of its own class, by its place among them; all else stays."""
    one = lambda x: (
        F.when(x["c"].rlike("^[0-9]$"), (_number(hex_text, x["k"]) % 10).cast("string"))
        .when(x["c"].rlike("^[a-z]$"), F.char(_number(hex_text, x["k"]) % 26 + 97))
        .when(x["c"].rlike("^[A-Z]$"), F.char(_number(hex_text, x["k"]) % 26 + 65))
        .otherwise(x["c"])
    )
    return F.array_join(F.transform(_places(text, "A-Za-z0-9"), one), "")


def _lay(value: Column, made: Column, mark: str = "0-9") -> Column:
    """value with its characters of the class `mark` replaced by those of made, in turn."""
    letters = F.split(made, "")
    return F.array_join(F.transform(_places(value, mark), lambda x: F.when(x["c"].rlike(f"^[{mark}]$"), F.get(letters, x["k"])).otherwise(x["c"])), "")


def _luhn_sum(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _luhn(digits: Column) -> Column:
    """A digit string whose last digit is set so that the usual check sum holds."""
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(head, ((10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10).cast("string"))


def _iban(made: Column) -> Column:
    """An account number with its two check digits set (remainder 1 modulo 97)."""
    text = F.concat(F.substring(made, F.lit(5), F.length(made)), F.substring(made, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda a, v: (F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97)
    return F.concat(F.substring(made, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(made, F.lit(5), F.length(made)))


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _script(word: Column) -> Column:
    """struct(first, second, end) of a word's script; second is null where letters do not take turns."""
    made = None
    for script, (first, second, end) in reversed(SCRIPTS.items()):
        row = F.struct(F.lit(first).alias("first"), F.lit(second).cast("string").alias("second"), F.lit(end).alias("end"))
        made = row if made is None else F.when(word.rlike(rf"\p{{{script}}}"), row).otherwise(made)
    return made


def _name_word(word: Column, key: str, woman: Column, given: Column) -> Column:
    """A made-up word of the same script for a word of a name, the same for the same word; a given name of a woman ends so."""
    bound = F.struct(F.sha2(F.concat(F.lit(f"{key}|word|"), F.lower(word)), 512).alias("hx"), _script(word).alias("s"))

    def out(x: Column) -> Column:
        turns = x["s"]["second"].isNotNull()
        letters = lambda j: F.when(turns & (j % 2 == 1), x["s"]["second"]).otherwise(x["s"]["first"])
        one = lambda j: F.substring(letters(j), _number(x["hx"], j) % F.length(letters(j)) + 1, F.lit(1))
        drawn = F.array_join(F.transform(F.sequence(F.lit(0), F.when(turns, 6).otherwise(F.length(word) - 1)), one), "")
        return F.when(turns, F.initcap(F.concat(drawn, F.when(given & woman, x["s"]["end"]).otherwise("")))).otherwise(drawn)

    made = _bind(bound, out)
    return F.when((F.length(word) > 1) & (F.upper(word) == word) & (F.lower(word) != word), F.upper(made)).otherwise(made)


def _name_parts(value: Column) -> Column:
    """Words of a name without its form of address."""
    return F.filter(F.split(value, " "), lambda w: ~F.regexp_replace(w, r"\.$", "").isin(*MALE, *FEMALE, *NEUTRAL))


def _is_woman(value: Column) -> Column:
    words = F.transform(F.split(value, " "), lambda w: F.regexp_replace(w, r"\.$", ""))
    return F.exists(words, lambda w: w.isin(*FEMALE, *GIVEN_FEMALE))


def _name(value: Column, key: str) -> Column:
    """The form of address stays; each other word becomes one of its script. Words before the last are given names."""
    parts, woman = F.size(_name_parts(value)), _is_woman(value)
    words = F.split(value, " ")

    def one(word, i):
        address = F.regexp_replace(word, r"\.$", "").isin(*MALE, *FEMALE, *NEUTRAL)
        given = (i < F.size(words) - 1) & (parts > 1)
        return F.when(address, word).otherwise(_name_word(word, key, woman, given))

    return F.array_join(F.transform(words, one), " ")


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        if kind == "secret":  # found between quotes, which the entity does not hold
            pattern = r"[A-Za-z0-9_\-]{20,120}"
        elif kind == "ssn":  # found after its label
            pattern = r"[0-9]{3}[ \-]?[0-9]{2}[ \-]?[0-9]{4}"
        elif kind == "name":  # a form of address may follow it
            pattern += rf"|{_CJK}{{1,6}}"
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return F.coalesce(out, F.lit("secret"))


def is_entity(value: Column) -> Column:
    """Whether what the pattern found is one: digits in groups are a card only if they begin and count as an issuer's do
    (a card stays one if a digit is mistyped), or if their check sum holds."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    issuer = digits.rlike(r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$")
    return (kind_of(value) != "card") | issuer | (_luhn_sum(digits) % 10 == 0)


def canonical(kind: Column, value: Column) -> Column:
    """What an entity is however it is written."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, "[^0-9]", "")).when(kind.isin("email", "ipv6"), F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "name", F.lower(F.array_join(_name_parts(value), " "))).otherwise(value)
    )


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """The candidate surrogate of an entity: a function of the key, its canonical form, its writing and the attempt alone."""
    form = canonical(kind, value)
    bound = F.struct(form.alias("form"), F.sha2(F.concat(F.lit(f"{key}|{attempt}|"), kind, F.lit("|"), form), 512).alias("hx"))

    def made(x: Column) -> Column:
        hx, form = x["hx"], x["form"]
        at = F.substring_index(value, "@", 1)
        octet = lambda j, low, n: (_number(hx, F.lit(j)) % n + low).cast("string")
        domain = F.regexp_replace(F.substring(value, F.length(at) + 2, F.length(value)), r"\.[^.]*$", "")
        country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(\-])", 0)
        hexes = lambda c: F.when(c["c"].rlike("^[0-9A-F]$"), F.hex(_number(hx, c["k"]) % 16)).when(c["c"].rlike("^[a-f]$"), F.lower(F.hex(_number(hx, c["k"]) % 16))).otherwise(c["c"])
        return F.coalesce(
            F.when(kind == "email", F.concat(_like(at, hx), F.lit("@"), _like(domain, F.sha2(F.concat(F.lit(key), hx), 512)), F.lit(".example")))
            .when(kind == "phone", F.concat(country, _like(F.substring(value, F.length(country) + 1, F.length(value)), hx)))
            .when(kind == "ip", F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
            .when(kind == "ipv6", F.array_join(F.transform(_places(value, "0-9A-Fa-f"), hexes), ""))
            .when(kind == "card", _lay(value, _luhn(F.concat(F.substring(form, 1, 1), _like(F.substring(form, F.lit(2), F.length(form) - 1), hx)))))
            .when(kind == "ssn", _lay(value, F.concat(F.lit("9"), F.substring(_like(form, hx), F.lit(2), F.length(form)))))
            .when(kind == "iban", _lay(value, _iban(F.concat(F.substring(form, 1, 2), _like(F.substring(form, F.lit(3), F.length(form)), hx))), "A-Z0-9"))
            .when(kind == "name", _name(value, f"{key}|{attempt}")),
            _like(value, hx),
        )

    return _bind(bound, made)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """value -> surrogate for distinct entities (kind, value): different canonical forms never share a surrogate, and none
    is an entity that occurs.

    Forms are compared as they are in canonical writing. A surrogate is taken by the entity that has it as its own form
    first, then by the form that took it in an earlier attempt, then by the smallest form; who loses tries again. The
    forms still open and those settled are written to the checkpoint folder after each attempt. RuntimeError if a
    type's values are used up.
    """
    rows = cut(entities.select("kind", "value", canonical(F.col("kind"), F.col("value")).alias("form")))
    forms = rows.groupBy("kind", "form").agg(F.min("value").alias("value"))
    taken = forms.select("kind", F.col("form").alias("made"))
    pending, settled = forms, None
    for attempt in range(MOST_ATTEMPTS):
        tried = pending.withColumn("_made", surrogate(F.col("kind"), F.col("value"), key, attempt)).withColumn("made", canonical(F.col("kind"), F.col("_made"))).drop("_made")
        first = F.row_number().over(Window.partitionBy("kind", "made").orderBy("form")) == 1
        against = taken if settled is None else taken.unionByName(settled.select("kind", "made"))
        known = against.distinct().withColumn("_taken", F.lit(True))
        tried = cut(tried.withColumn("_first", first).join(known, ["kind", "made"], "left").withColumn("lost", F.col("_taken").isNotNull() | ~F.col("_first")).select("kind", "form", "value", "made", "lost"))
        won = tried.filter("not lost").select("kind", "form", "made", F.lit(attempt).alias("attempt"))
        settled = won if settled is None else cut(settled.unionByName(won))
        pending = tried.filter("lost").select("kind", "form", "value")
        if pending.isEmpty():
            break
    else:
        raise RuntimeError(f"surrogates still meet after {MOST_ATTEMPTS} attempts")
    out = rows.join(settled.select("kind", "form", "attempt"), ["kind", "form"])
    at = F.col("attempt")
    made = surrogate(F.col("kind"), F.col("value"), key, 0)
    for n in range(1, attempt + 1):
        made = F.when(at == n, surrogate(F.col("kind"), F.col("value"), key, n)).otherwise(made)
    return out.select("value", made.alias("surrogate"))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities, n_distinct_entities.

    key: the secret that surrogates depend on; who does not know it cannot make them. Texts without an entity pass as they
    are, without a shuffle; null text stays null with 0 entities. Null ids and repeated rows stay; other columns are
    dropped; an empty table gives no rows. Texts are searched twice: once to take out those with entities, which are few and
    written to the checkpoint folder, and once to pass the others. The work is done once for each distinct text (by
    its digest), so copies and repeated rows cost nothing and an entity in very many texts is only a skewed join
    key, which adaptive execution splits.
    """
    if not key:
        raise ValueError("surrogates need a key")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    has = F.coalesce(F.size(found), F.lit(0)) > 0
    hit = cut(base.select("doc_id", "text", found.alias("found")).filter(F.size("found") > 0).select("*", F.md5("text").alias("digest")))
    pairs = hit.select("digest", F.explode(F.array_distinct("found")).alias("value")).distinct().filter(is_entity(F.col("value")))
    entities = pairs.select("value").distinct().select(kind_of(F.col("value")).alias("kind"), "value")
    maps = pairs.join(assign(entities, key), "value").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("made"))
    gaps = F.split("text", PATTERN, -1)
    made = lambda v: F.try_element_at(F.col("made"), v)
    rebuilt = F.array_join(F.zip_with(gaps, F.col("found"), lambda g, v: F.concat(g, F.coalesce(made(v), v, F.lit("")))), "")
    real = F.filter("found", lambda v: made(v).isNotNull())
    none = F.lit(0).cast("long")
    changed = hit.join(maps, "digest", "left").select("doc_id", F.when(F.col("made").isNull(), F.col("text")).otherwise(rebuilt).alias("text"), F.coalesce(F.size(real).cast("long"), none).alias("n_entities"), F.coalesce(F.size(F.array_distinct(real)).cast("long"), none).alias("n_distinct_entities"))
    return base.filter(~has).select("doc_id", "text", none.alias("n_entities"), none.alias("n_distinct_entities")).unionByName(changed)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session's configuration; without one a run makes its own and nobody keeps it."""
    return replace_entities(parquet(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))
