import random
import re

import pytest

from reckon.llm import surrogates

TEXT = "Mail ann.lee+3@mail5.example.com or +1 (743) 555-3824; card 4438189355774160, host 172.242.194.228, ssn 078-05-1120, key \"ab12cd34ef56ab12cd34ef56ab\"; Mr. John Smith and Mrs Anna Smith met Г-н. Господин Иванов came."


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, rows, key="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities string")
    return surrogates.replace_entities(df, key)


def test_types_formats_and_coreference(spark):
    rows = [(1, TEXT, "x"), (2, "Again ann.lee+3@mail5.example.com and Mr. John Smith.", "x"), (3, "clean text 12 of 2024, see p. 3.4", "x")]
    got = {r.doc_id: r for r in run(spark, rows).collect()}
    a, b = got[1].text, got[2].text
    assert got[3].text == rows[2][1] and got[3].n_entities == 0
    for old in ("ann.lee+3@", "743) 555-3824", "4438189355774160", "172.242.194.228", "078-05-1120", "ab12cd34ef56", "John", "Anna", "Smith", "Иванов"):
        assert old not in a
    mail = re.search(r"\S+@\S+", a)[0]
    assert mail.endswith(".example") and mail in b and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\+\d@.*", mail)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", a) and luhn(re.search(r"card (\d{16}),", a)[1])
    assert re.search(r"host (\d{1,3}\.){3}\d{1,3},", a) and re.search(r"ssn 9\d\d-\d\d-\d{4},", a)
    male, female = re.search(r"Mr\. (\w+) (\w+) and Mrs (\w+) (\w+) met", a).group(1, 2), re.search(r"Mrs (\w+) (\w+)", a).group(1, 2)
    assert male[1] == female[1] and female[0].endswith("a") and f"Mr. {male[0]} {male[1]}." in b
    assert re.search(r"Господин [А-Яа-я]+ came", a)
    assert run(spark, rows, key="other").filter("doc_id = 1").first().text != a


def test_surrogates_stay_distinct(spark):
    values = [f"10.0.{i // 250}.{i % 250}" for i in range(4000)]
    made = surrogates.assign(spark.createDataFrame([("ip", v) for v in values], "kind string, value string"), "k").collect()
    out = [r.surrogate for r in made]
    assert len(made) == 4000 and len(set(out)) == 4000 and not set(out) & set(values)
    one = spark.createDataFrame([("card", f"4{i:012d}") for i in range(300)] + [("ssn", f"{i:03d}-00-0000") for i in range(300)], "kind string, value string").distinct()
    got = [r.surrogate for r in surrogates.assign(one, "k").collect()]
    assert len(got) == len(set(got)) == one.count()


def test_collisions_are_resolved(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(surrogates, "surrogate", lambda kind, value, key, attempt: F.concat(F.lit("same"), F.lit(str(attempt))))
    rows = spark.createDataFrame([("x", v) for v in ("a", "b", "c", "same0")], "kind string, value string")
    got = {r.value: r.surrogate for r in surrogates.assign(rows, "k").collect()}
    assert len(set(got.values())) == 4 and not set(got.values()) & {"a", "b", "c", "same0"}


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (None, "a@b.co", "x"), (4, "a@b.co " * 3000, "x"), (5, "a@b.co", "x")]
    got = run(spark, rows).collect()
    assert len(got) == 6
    assert sorted(r.n_entities for r in got) == [0, 0, 1, 1, 1, 3000]
    assert len({re.search(r"\S+@\S+", r.text)[0] for r in got if r.n_entities}) == 1
    empty = spark.createDataFrame(rows, "doc_id long, text string, n_entities string").limit(0)
    assert surrogates.replace_entities(empty, "k").count() == 0
    with pytest.raises(ValueError):
        surrogates.replace_entities(empty, "")


def only(spark, text, key="k"):
    return run(spark, [(1, text, "x")], key).first()


@pytest.mark.parametrize("text, gone", [
    ("we met John Smith there", ["John", "Smith"]), ("ask Dr Alice Jones now", ["Alice", "Jones"]), ("dear Mr 田中 and 山田さん came", ["田中", "山田"]), ("call (743) 555-3824 today", ["555-3824"]),
    ("call 743-555-3824 today", ["555-3824"]), ("SSN 078 05 1120 on file", ["078 05"]), ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", ["8a2e", "85a3"]), ("host fe80::1ff:fe23:4567 up", ["fe23"]),
    ("Mr Γιώργος Παπαδόπουλος here", ["Γιώργος", "Παπαδόπουλος"]), ("IBAN GB82 WEST 1234 5698 7654 32 ok", ["WEST 1234"]),
])
def test_what_is_found(spark, text, gone):
    got = only(spark, text)
    assert got.n_entities >= 1 and not any(g in got.text for g in gone)


def test_what_is_left_alone(spark):
    for text in ("order 1234567890123456 shipped", "The John of old", "std::vector and 12:30:45 in 2024-05-06", "Dr ahead, Mr and Mrs", "version 1.2.3 of 10.5", "Smith met Jones"):
        got = only(spark, text)
        assert got.text == text and got.n_entities == 0, text


def test_scripts_stay(spark):
    import unicodedata

    script = lambda word: {unicodedata.name(c).split()[0] for c in word if c.isalpha()}
    for text, words in (("Mr Γιώργος Παπαδόπουλος", 2), ("Господин Иван Петров", 2), ("Mr John Smith", 2), ("山田さん", 1), ("Mrs Анна Иванова", 2)):
        old, new = text.split()[-words:], only(spark, text).text.split()[-words:]
        assert old != new and [script(w.replace("さん", "")) for w in old] == [script(w.replace("さん", "")) for w in new], (old, new)


def test_one_surrogate_however_it_is_written(spark):
    text = "4438189355774160 4438 1893 5577 4160 4438-1893-5577-4160; +1 (743) 555-3824 and +1 743 555 3824; Ann@X.com ann@x.com; Mr. John Smith, John Smith"
    made = only(spark, text).text
    cards = re.findall(r"(?<![0-9])(?:[0-9][ -]?){15}[0-9](?![0-9])", made.split(";")[0])
    digits = re.sub(r"[^0-9]", "", made.split(";")[0])
    assert digits[:16] == digits[16:32] == digits[32:] and luhn(digits[:16]) and digits[:16] != "4438189355774160", cards
    phones = [re.sub("[^0-9]", "", x) for x in made.split(";")[1].split("and")]
    assert phones[0] == phones[1] != "17435553824"
    mails = made.split(";")[2].split()
    assert mails[0].lower() == mails[1] and mails[0][0].isupper()
    names = made.split(";")[3].replace("Mr.", "").split(",")
    assert names[0].strip() == names[1].strip() != "John Smith"


def test_check_digits_of_accounts(spark):
    made = re.search(r"IBAN (.*) ok", only(spark, "IBAN GB82 WEST 1234 5698 7654 32 ok").text)[1]
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", made)
    bare = made.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_gaps_stay_and_all_equal_entities_change_alike(spark):
    """Against plain cutting: what lies between entities is untouched, and one entity has one surrogate in all texts."""
    rng = random.Random(5)
    pool = [f"user{i}@mail.example.com" for i in range(30)] + [f"10.{i}.7.{i + 3}" for i in range(30)] + [f"+1 (743) 555-{3000 + i}" for i in range(30)]
    filler = ["plain", "words", "of 12 items,", "Ünïcode", "line\nbreak"]
    rows, parts = [], {}
    for i in range(60):
        each = [(rng.choice(filler), rng.choice(pool)) for _ in range(rng.randint(0, 8))]
        parts[i] = each
        rows.append((i, " ".join(f"{g} {e}" for g, e in each) + " end", "x"))
    made = {}
    for r in run(spark, rows).collect():
        assert r.n_entities == len(parts[r.doc_id]) and r.n_distinct_entities == len({e for _, e in parts[r.doc_id]})
        rest = r.text
        for gap, entity in parts[r.doc_id]:
            assert rest.startswith(f"{gap} ")
            rest = rest[len(gap) + 1 :]
            size = len(entity) if "@" not in entity else rest.index(" ")
            size = rest.index(" ") if entity.startswith("10.") else size
            assert made.setdefault(entity, rest[:size]) == rest[:size]
            rest = rest[size + 1 :]
        assert rest.strip() == "end"
    assert len(set(made.values())) == len(made) and not set(made.values()) & set(pool)
