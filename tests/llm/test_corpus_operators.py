"""Deduplication, surrogates, decontamination and the pipeline on small tables."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import catalog, decontaminate, exact_dedup, graph, line_dedup, near_dedup, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, lines string, new string"
LONG = "Line one of many words here\n" * 3000
ODD = [
    (1, "", "en", "a", 0, "x", "y", "z"),
    (2, None, "en", None, None, "x", "y", "z"),
    (None, "no id here at all", None, "a", 10, None, None, None),
    (3, "the same text in two rows", "en", "a", 9, "x", "y", "z"),
    (3, "the same text in two rows", "en", "a", 9, "x", "y", "z"),
    (4, LONG, "en", "b", len(LONG), "x", "y", "z"),
    (5, "\n\n\n  \t !?", "de", "b", 1, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir), catalog.ORACLE[name]) is None


# --- components and near duplicates ----------------------------------------


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    where, links = defaultdict(list), []
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x])
        links += [(i, j) for j, k in common.items() if 100 * k >= 75 * (len(s) + len(sets[j]) - k)]
        for x in s:
            where[x].append(i)
    return {i: len(s) for i, s in sets.items()}, roots(sets, links)


def test_near_duplicates_of_test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size, root = brute_near([(r.doc_id, r.text) for r in docs.collect()])
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(size)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], root[r.doc_id], r.doc_id == root[r.doc_id])


def test_near_duplicates_at_the_threshold(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for _ in range(12):  # groups whose members drift around the threshold
        base = [draw.choice(words) for _ in range(draw.choice([6, 30, 120]))]
        for _ in range(12):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(own) // 30))):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = brute_near(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == root


def test_near_duplicates_in_a_family_below_the_threshold(spark):
    # All share boilerplate at 0.72 to 0.75, and pairs in it reach 0.75 to 0.78:
    # only exact tests of members against each other find those.
    draw = random.Random(10)
    stem = [f"s{i}" for i in range(604)]
    rows = []
    for k in range(150):
        common = [f"c{k}.{i}" for i in range(draw.randint(0, 20))]
        for m in range(2):
            own = [f"o{k}.{m}.{i}" for i in range(draw.randint(101, 114) - len(common))]
            rows.append((2 * k + m, " ".join([*stem, *common, *own])))
    # A large class beside the family.
    rows += [(1000 + i, " ".join([*stem, *(f"g{j}" for j in range(100)), f"x{i}"])) for i in range(60)]
    size, root = brute_near(rows)
    assert 100 < len(set(root.values())) < len(rows) - 90
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == root


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for r in of[3]] == [(2, 3, True)] * 2
    assert all(r.n_shingles == 0 and r.component_id == i for i in (1, 2) for r in of[i])
    assert of[None][0].component_id is None and of[None][0].kept
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(ODD) - 1
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_texts_that_share_an_id_are_different_documents(spark):
    draw = random.Random(9)
    a, b, c = ([f"{x}{draw.randrange(9999)}" for _ in range(80)] for x in "abc")
    near = [[*t[:-1], "end"] for t in (a, b)]
    texts = [(3, a), (3, b), (5, near[0]), (7, near[1]), (9, c), (9, c), (None, a)]
    rows = [(i, " ".join(t), k) for k, (i, t) in enumerate(texts)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, id long").repartition(3)
        out = near_dedup.drop_near_duplicates(docs)
        kept = Counter((r.doc_id, r.text) for r in out.collect())
        assert out.columns == docs.columns
        assert kept == Counter((i, " ".join(t)) for i, t in ((3, a), (3, b), (9, c), (None, a)))


def test_sketch_estimates_and_merges():
    sketch, draw = near_dedup.Sketch(), np.random.default_rng(3)
    items = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        k = int(2000 * share)
        a, b = items[:2000], np.concatenate([items[:k], items[2000 : 4000 - k]])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = sketch.registers(a), sketch.registers(b)
        n = np.array([[len(a)], [len(b)]], float)
        estimate, doubt = sketch.likelihood(ra[None], rb[None], n[0], n[1])
        assert abs(estimate[0] - j) < 0.16
        union = near_dedup.merge(ra.tobytes(), rb.tobytes())
        assert union == sketch.registers(np.union1d(a, b)).tobytes()
    far = sketch.likelihood(sketch.registers(items[:900])[None], sketch.registers(items[900:1800])[None], *np.full((2, 1), 900.0))
    assert far[1][0] > sketch.doubt


# --- exact copies ----------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), t or "")].append(i)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, tmp_path, monkeypatch, weak):
    monkeypatch.setattr(exact_dedup, "PART", 7)
    draw = random.Random(4)
    rows = [(i, draw.choice(["A b", "a B", "É", "é", "", None, f"t{i}", "a\n"])) for i in range(150)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    digest = (lambda c: F.substring(exact_dedup.sha256(c), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_copies(spark, path, digest, maxFilesPerTrigger="2").collect()
    groups = {i: g for g in brute_exact(rows).values() for i in g}
    assert len(got) == len(rows)
    for r in got:
        g = groups[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))


def test_exact_copies_of_odd_rows(spark, odd, empty, tmp_path):
    for name, frame in (("odd", odd), ("empty", empty)):
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    rows = exact_dedup.exact_copies(spark, str(tmp_path / "odd")).collect()
    assert len(rows) == len(ODD)
    assert sum(r.kept for r in rows if r.doc_id == 3) == 1
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id in (1, 2)} == {(1, 2, 2, False), (2, 2, 2, True)}
    assert [(r.keep_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert exact_dedup.exact_copies(spark, str(tmp_path / "empty")).count() == 0


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, checkpoint = str(tmp_path / "docs"), str(tmp_path / "state")
    for part in ([(1, "a"), (2, "b")], [(3, "A")]):
        spark.createDataFrame(part, "doc_id long, text string").write.mode("append").parquet(path)
        state = exact_dedup.digest_state(spark, path, checkpoint)
    assert sorted((r.keep.doc_id, r.n) for r in state.collect()) == [(2, 1), (3, 2)]


# --- lines -----------------------------------------------------------------


def brute_lines(rows):
    seen, gone = set(), defaultdict(set)
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if not re.search(r"\S", "".join(window)):
                continue
            if window in seen:
                gone[i] |= {p, p + 1, p + 2}
            seen.add(window)
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]) for i, t in rows}


def test_lines_against_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c", "", " "]) for _ in range(draw.randint(0, 14)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_lines == rows[i][1].count("\n") + 1 for i, r in got.items())


def test_lines_of_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == len(ODD) and out.columns == [*odd.columns, "n_lines", "n_removed"]
    of = {r.doc_id: r for r in rows}
    assert of[2].text is None and of[2].n_lines == 0 and of[1].text == "" and of[1].n_lines == 1
    assert of[3].text == ODD[3][1] and of[5].text == ODD[6][1] and of[3].lines == "y" and of[3]["_row"] == "x"
    assert of[4].text.count("\n") <= 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_stay_in_the_jvm(spark, odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- benchmark windows -----------------------------------------------------


def brute_hits(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = {}
    for i, t in docs:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            size = min(len(w), 10)
            for a in range(len(w) - size + 1 if w else 0):
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == w[a : a + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        out[i] = (len(own), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_windows_against_brute_force(spark, block):
    draw = random.Random(7)
    vocabulary = ["a", "b", "c7", "É", "été", "d"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 3, 10, 13])))) for i in range(6)]
    docs = []
    for i in range(40):
        parts = [draw.choice(vocabulary).upper() for _ in range(draw.randint(0, 8))]
        docs.append((i, "; ".join([*parts, draw.choice(items)[1] if i % 3 else "", *parts])))
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        block=block,
    ).withColumn("n_hit", decontaminate.n_hit(F.col("spans")))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == brute_hits(docs, items)


def test_windows_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (None, "no id here"), (9, "the same text"), (9, "the same text")], "item_id long, text string"
    )
    got = decontaminate.contamination(odd, items)
    of = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ODD)
    assert of[3]["items"] == ["9"] and of[None]["items"] == [""] and of[2].n_words == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter(F.size("spans") > 0).count() == 0
    left = decontaminate.drop_contaminated(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 5]


# --- surrogates ------------------------------------------------------------

TEXTS = [
    (1, "Mail Anna.Lee@mail4.example.com or call +1 (017) 555-7713 about card 4539 1488 0343 6467 from 10.0.12.255."),
    (2, "Mr. John Smith met Mary Smith; MR. SMITH paid by 4539148803436467, host 10.0.12.255"),
    (3, "Frau Petra Müller, Herr Müller und господин Иван Петров, IBAN DE89 3704 0044 0532 0130 00"),
    (4, "nothing here but 12 numbers and 3.14 of them"),
    (5, 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of ANNA.LEE@MAIL4.EXAMPLE.COM'),
]


def test_surrogates_are_consistent(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, b"k").collect()}
    assert out[4].text == TEXTS[3][1] and out[4].n_entities == 0
    for private in ("Anna.Lee", "017", "4539 1488", "10.0.12", "John", "Smith", "SMITH", "Müller", "Петров", "3704", "9c8b"):
        assert not any(private in r.text for r in out.values()), private
    mail = re.search(r"\S+@\S+", out[1].text)[0]
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}@[a-z]{4}\d\.[a-z]{7}\.com", mail.title().replace("Com", "com")) or "@" in mail
    assert mail.lower() in out[5].text.lower()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1].text)
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", out[1].text)[0]
    assert card.replace(" ", "") in out[2].text and pii._luhn(card.replace(" ", "")) == 0
    names = re.match(r"Mr\. (\w+) (\w+) met (\w+) (\w+); MR\. (\w+) ", out[2].text).groups()
    assert names[1] == names[3] and names[4] == names[1].upper() and names[0] != names[2]
    assert names[2].endswith("ra") and names[0].endswith("n")
    german = re.match(r"Frau \w+ (\w+), Herr (\w+) und господин ([а-я]+) ([а-я]+),", out[3].text, re.I).groups()
    assert german[0] == german[1]
    assert re.search(r'"[0-9a-f]{40}"', out[5].text)
    again = {r.doc_id: r.text for r in pii.pseudonymise(docs, b"k").collect()}
    assert again == {i: r.text for i, r in out.items()}
    assert {r.doc_id: r.text for r in pii.pseudonymise(docs, b"other").collect()} != again


def test_surrogates_stay_distinct(spark):
    # 26 * 10 forms for 200 entities of one host: collisions are certain at first.
    mails = [f"{c}{i % 10}@x.org" for i, c in enumerate("abcdefghijklmnopqrst" * 10)]
    entities = spark.createDataFrame([("email", m) for m in sorted(set(mails))], "kind string, canon string")
    rows = pii.surrogates(entities, b"k").collect()
    assert len({r.surrogate for r in rows}) == len(rows) == len(set(mails))
    assert not {r.surrogate for r in rows} & set(mails)


ALONE = {
    "email": ["anna@example.org"],
    "secret": ["sk-" + "abcde" * 4, "AKIA" + "ABCD" * 4, "ghp_" + "abcdef" * 6, "abcdef" * 6, "sk-ab-cd_" + "e" * 20],
    "iban": ["DE89 3704 0044 0532 0130 00"],
    "ip6": ["2001:db8:85a3::8a2e:370:7334", "2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "fe80::1:2:3"],
    "ip": ["10.0.12.255", "١.٢.٣.٤"],
    "ssn": ["123-45-6789", "١٢٣-٤٥-٦٧٨٩"],
    "card": ["4539 1488 0343 6467", "٤٥٣٩ ١٤٨٨ ٠٣٤٣ ٦٤٦٧"],
    "phone": ["+1 (017) 555-7713", "+٤٩ ٣٠ ١٢٣٤ ٥٦٧٨", "(017) 555-7713", "०१७-५५५-७७१३"],
}


def test_every_mention_alone_is_replaced(spark):
    assert ALONE.keys() == pii._PATTERNS.keys()
    rows = [(k, t) for k, (_, t) in enumerate((kind, t) for kind, ts in ALONE.items() for t in ts)]
    kinds = [kind for kind, ts in ALONE.items() for _ in ts]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    new = {r.doc_id: r.text for r in out}
    for (k, text), kind in zip(rows, kinds, strict=True):
        assert [m[2] for m in pii.mentions(text)] == [kind] and new[k] != text, text
        assert [m[2] for m in pii.mentions(new[k])] == [kind], (text, new[k])
        scripts = [{c.isascii() for c in t if c.isdecimal()} for t in (text, new[k])]
        assert kind == "secret" or scripts[0] == scripts[1], (text, new[k])
    # The same number in other digits is the same entity.
    card = ["".join(str(int(c)) for c in new[k] if c.isdecimal()) for k, t in rows if kinds[k] == "card"]
    assert card[0] == card[1]


def surrogates_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.pseudonymise(docs, b"k").collect(), key=lambda r: r.doc_id)]


def test_one_phone_number_in_every_format(spark):
    german = ["+49 30 1234567", "+49301234567", "+49-30-123-4567", "+49 (0)30 1234567", "+49 (30) 1234567"]
    home = ["(212) 555-0134", "+1 212 555 0134", "212-555-0134", "+12125550134", "+1 (212) 555-0134"]
    out = surrogates_of(spark, german + home)
    digits = [re.sub(r"\D", "", t.replace("(0)", "")) for t in out]
    assert len(set(digits[:5])) == 1 and digits[0].startswith("49") and digits[0] != "49301234567"
    full = [d if d.startswith("1") and len(d) == 11 else "1" + d for d in digits[5:]]
    assert len(set(full)) == 1 and full[0] != "12125550134"
    shapes = [re.sub(r"\d", "0", t) for t in out]
    assert shapes == [re.sub(r"\d", "0", t) for t in german + home]


def test_scripts_and_check_digits_stay(spark):
    texts = ["иван.петров@пример.рф", "Dr 王小明", "Dr Արամ", "Dr Παπαδόπουλος", "IBAN DE89 3704 0044 0532 0130 00"]
    out = surrogates_of(spark, texts)
    for old, new in zip(texts, out, strict=True):
        scripts = [[pii._script(c) for c in t if c.isalpha()] for t in (old, new)]
        assert set(scripts[0]) == set(scripts[1]) and old != new, (old, new)
    assert re.fullmatch(r"[а-я]{4}\.[а-я]{6}@[а-я]{6}\.рф", out[0]) and re.fullmatch(r"Dr \w{3}", out[1])
    iban = out[4][5:].replace(" ", "")
    assert iban.startswith("DE") and pii._mod97(iban) == 1 and "3704 0044" not in out[4]


def test_clean_texts_stay(spark):
    clean = [
        "ISBN 9781234567897", "at 20240101123045", "parts DE12 ABCD EFGH in stock", "Mr The President spoke",
        "std::vector<int> a::b::c 12:34:56", "a ratio of 1:2:3:4", "version 1.2.3.4.5",
    ]
    assert surrogates_of(spark, clean) == clean


def test_written_surrogates_against_brute_force(spark):
    """What is written maps entities to surrogates one to one, and no real one returns."""
    draw = random.Random(5)
    kinds = {
        "phone": lambda: draw.choice(["+1 (%03d) 555-%04d", "(%03d) 555-%04d", "+44 20 %03d %04d"])
        % (draw.randrange(200, 215), draw.randrange(60)),
        "email": lambda: draw.choice("abcdefgh") + str(draw.randrange(10)) + "@x.org",
        "ip": lambda: "10.%d.0.%d" % (draw.randrange(10), draw.randrange(10)),
        "ssn": lambda: "%03d-12-%04d" % (draw.randrange(9), draw.randrange(60)),
    }
    texts = [kinds[k]() for k in kinds for _ in range(400)]

    def key(text):
        digits = re.sub(r"\D", "", text)
        if re.fullmatch(r"(\+1 )?\(\d{3}\) .*", text):
            return "phone 1" + digits[-10:]
        return "phone " + digits if text.startswith("+") else text

    new = surrogates_of(spark, texts)
    pairs = {(key(a), key(b)) for a, b in zip(texts, new, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert not {a for a, _ in pairs} & {b for _, b in pairs}


def test_hint_knows_every_digit():
    digits = pa.array([chr(c) for c in range(0x110000) if chr(c).isdecimal()])
    assert pc.all(pc.match_substring_regex(digits, pii._HINT)).as_py()


def test_surrogates_of_odd_rows(odd, empty):
    out = pii.pseudonymise(odd, b"k")
    rows = out.collect()
    assert len(rows) == len(ODD) and out.columns == [*odd.columns, "n_entities", "n_distinct"]
    assert Counter((r.doc_id, r.text, r.new) for r in rows) == Counter((r[0], r[1], r[7]) for r in ODD)
    assert pii.pseudonymise(empty, b"k").count() == 0


# --- pipeline --------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").persist()
    before, names = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).persist()
        assert out.columns == names and 0.7 * before < out.count() <= before, name
        if name == "near_dedup":
            _, root = brute_near([(r.doc_id, r.text) for r in docs.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in root.items() if i == c)
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id: r.text for r in out.collect()} == want
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id: r.text for r in last.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_pipeline_of_odd_rows(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()


def test_hostile_words_are_not_linked(spark):
    """Words whose hashes agree modulo 2^64 make no near duplicates."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = near_dedup.near_duplicates(rows).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.lit("one digest")])
def test_half_of_the_rows_are_one_text(spark, tmp_path, digest, monkeypatch):
    """Frequent texts meet their state in parts, repeated largest ids keep one row,
    also where all texts share a digest."""
    monkeypatch.setattr(exact_dedup, "PART", 8)
    rows = [(i, "Often Copied") for i in range(300)] + [(i, f"text {i % 90}") for i in range(300, 560)]
    rows += [(299, "often copied"), (559, "TEXT 19"), (None, "often copied")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    groups = defaultdict(list)
    for i, text in rows:
        groups[text.lower()].append(i)
    want = {t: (max(x for x in ids if x is not None), len(ids)) for t, ids in groups.items()}
    got = exact_dedup.exact_copies(spark, path, digest).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, *want[t.lower()]) for i, t in rows)
    assert sum(r.kept for r in got) == len(want) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_no_text_moves_while_windows_are_sought(spark):
    """The names of contaminated documents are written before they meet the documents."""
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "clean words"), (None, passage), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, items)
    assert "MapInArrow" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_sketches_hold_few_texts_at_once(spark):
    """A task's arrays for 8 MB of texts stay below a tenth of the memory that an executor's worker has."""

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(3500)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    run = near_dedup.sketches(Rows(), near_dedup.Sketch())
    tracemalloc.start()
    n = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 50 << 20


def test_bands_meet_their_buckets_once(spark, monkeypatch):
    """After the members of shared buckets are written, no step reads the bands of all documents."""
    plans, write = {}, near_dedup.staged

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_dedup, "staged", noted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i])) for i in range(5)] + [(9, "another text of some other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}
    assert all("posexplode" not in plans[name] for name in ("pairs", "open"))
