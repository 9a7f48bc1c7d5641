"""Surrogates: kinds, forms, distinctness and coreference."""

import re

import odd
from pyspark.sql import functions as F

from urbanpulse.llm import privacy

TEXTS = [
    "Write to Anna.Lee@Mail.example.org or anna.lee@mail.example.org today", "card 4111-1111-1111-1111 or 4111111111111111, wrong 4111111111111112",
    "call +1 (504) 555-2652 or 504-555-2652, 10.0.0.1 and 300.1.1.1", "token = \"9742a250774262d69ad6a86100194ed53da5a0ef\"### 123-45-6789",
    "Mr. John Smith met Mrs. Mary Smith. MR. is no name; Mr. Smith left. г-жа Анна Петрова, г-н Иван Петров", "DE89 3704 0044 0532 0130 00",
    "clean text of 12 words in 2024-01-01, 3.14 and 1,000,000 and v1.2.3", "anna.lee@mail.example.org again",
]


def replaced(spark, texts=TEXTS, key="k"):
    return odd.by_id(privacy.surrogate_texts(odd.documents(spark, texts), key))


def right_check_digit(card):
    digits = [int(c) for c in card if c.isdigit()][::-1]
    return sum(digits[::2] + [d * 2 - 9 * (d > 4) for d in digits[1::2]]) % 10 == 0


def test_kinds_and_forms(spark):
    got = {i: r.text for i, r in replaced(spark).items()}
    first, second = re.findall(r"\S+@\S+", got[0])
    assert first.lower() == second == got[7].split()[0] and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.[a-z]{7}\.org", first)
    cards = re.findall(r"4[\d-]{15,18}", got[1])
    assert cards[0].replace("-", "") == cards[1] and [right_check_digit(c) for c in cards] == [True, True, False]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}, (\d{1,3}\.){3}\d{1,3} and 300\.1\.1\.1", got[2])
    assert re.fullmatch(r'token = "[0-9a-f]{40}"### \d{3}-\d{2}-\d{4}', got[3])
    assert got[5][:2] == "DE" and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[5])
    assert got[6] == TEXTS[6]
    john, mary, smith, anna, ivan = re.findall(r"(?:Mrs?\.|г-жа|г-н) (\w+ \w+|\w+)", got[4].replace("MR. is no name", ""))
    assert john.split()[1] == mary.split()[1] == smith.split()[0]
    assert john.split()[0] in privacy.MALE["latin"] and mary.split()[0] in privacy.FEMALE["latin"]
    assert anna.split()[0] in privacy.FEMALE["cyrillic"] and anna.endswith("ова") and ivan.split()[0] in privacy.MALE["cyrillic"] and ivan.endswith("ов")
    for gone in ("Lee", "4111", "504", "9742", "Smith", "Петров"):
        assert not any(gone in t for t in got.values())


def test_key_decides_the_surrogates(spark):
    one, same, other = (replaced(spark, TEXTS[:4], k) for k in ("a", "a", "b"))
    assert one == same and all(one[i].text != other[i].text for i in range(4))


def test_surrogates_differ_and_are_no_entities(spark):
    many = [("ip", f"10.0.{i}.{j}") for i in range(20) for j in range(100)] + [("card", f"{4 * 10**15 + i}") for i in range(200)]
    many += [("email", c + "@b.org") for c in "abcdefghijklmno"]  # 15 of 676: draws must collide
    table = privacy.surrogates(spark.createDataFrame(many, "kind string, canon string")).collect()
    assert {(r.kind, r.canon) for r in table} == set(many) and len(table) == len(many)
    assert len({(r.kind, r.surrogate) for r in table}) == len(many)
    assert not {(r.kind, r.surrogate) for r in table} & set(many)


def test_families_have_one_surrogate(spark):
    given = [f"{a}{b}o" for a in ("Ba", "Ce", "Di", "Fo", "Gu") for b in ("la", "me", "ni", "ro", "su", "ta", "ve", "xi")]
    texts = ["Mr. Smith and Mrs. Smith and Ms. Jones", "г-н Смит и г-жа Смит", "г-жа Анна Смит"]
    texts += [f"{title} {g} {f}" for title in ("Mr.", "Mrs.") for g in given for f in ("Smith", "Jones")]
    got = {i: r.text for i, r in replaced(spark, texts).items()}
    mr, mrs, jones = re.findall(r"M\w+\. (\w+)", got[0])
    assert mr == mrs != jones
    people = [got[i].split(" ") for i in range(3, len(texts))]
    assert {p[2] for p in people[::2]} == {mr} and {p[2] for p in people[1::2]} == {jones}
    assert len({tuple(p[1:]) for p in people}) == len(people)  # 40 given names of each family and gender, from 20
    him, her = re.findall(r"г-(?:н|жа) (\w+)", got[1])
    assert her == him + "а" and got[2].split()[2] == her


def test_long_entities_are_replaced_whole(spark):
    secret, local = "0f3a9c" * 86, "".join(f"part{i}." for i in range(30)) + "end"
    texts = [f"key {secret} end", f"to {local}@b.org now", "Mr. B" + "a" * 50 + " left", "a@bc.de_x@fg.hi", "x" * 300_000 + " 1", "a" * 31 + "1 b"]
    got = {i: r.text for i, r in replaced(spark, texts).items()}
    new = got[0].split()[1]
    assert re.fullmatch("[0-9a-f]{516}", new) and sum(a == b for a, b in zip(new, secret)) < 100
    assert re.fullmatch(r"to \S+@\S\.org now", got[1]) and "part" not in got[1] and len(got[1]) == len(texts[1])
    assert "aaa" not in got[2] and got[2].endswith(" left")
    assert "x@fg" not in got[3] and got[3].endswith(".hi") and ".de" in got[3]
    assert got[4] == texts[4] and got[5] != texts[5]


def test_odd_texts_and_all_columns(spark):
    docs = odd.documents(spark, [*odd.TEXTS, *TEXTS, TEXTS[0]])
    out = privacy.replaced(docs)
    assert out.dtypes == docs.dtypes and out.count() == docs.count()
    plain = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == plain[r.doc_id] for r in out.collect() if r.doc_id is not None and r.doc_id < len(odd.TEXTS))
    assert privacy.replaced(docs.limit(0)).count() == 0
    lost = privacy.replaced(spark.createDataFrame([(None, "x@y.org z"), (None, "x@y.org z")], "doc_id long, text string")).collect()
    assert len(lost) == 2 and lost[0] == lost[1] and lost[0].text.endswith(".org z") and "x@y" not in lost[0].text


def test_nothing_runs_in_python(spark):
    docs = odd.documents(spark, TEXTS)
    plan = privacy.replaced(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and docs.select(F.col("text")).count()
