"""Operators against brute force on small fixtures."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfrontier.llm import chosen_path, decontamination, html, mixing, pii, rules, sharding, substrings, tokens

VOCABULARY = [f"w{i}" for i in range(400)]


def corpus(seed: int, n: int = 120) -> list[tuple[int, str, str]]:
    rng, out = random.Random(seed), []
    passage = " ".join(rng.choices(VOCABULARY, k=45))
    for i in range(n):
        words = rng.choices(VOCABULARY, k=rng.choice([3, 12, 30, 80, 200]))
        if out and rng.random() < 0.4:
            words = rng.choice(out)[1].split()
            for _ in range(rng.choice([0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        if rng.random() < 0.3:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage.split()
        out.append((i, rng.choice([" ", "  ", "\n"]).join(words), f"s{min(rng.randrange(6), rng.randrange(6))}"))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus(1) + [(900 + i, "same words " * 30, "s0") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_mix_keeps_the_law(docs, rows):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs).collect()
    key = lambda r: (r["doc_id"], r["mix_copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["mix_size"] == len(r["text"].split()) and 0 <= r["mix_copies"] <= 3
        size[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        target[r["source"]] = r["mix_target"]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    want, open_, left = {}, set(size), float(sum(size.values()))
    while open_:  # reshare by weight until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size)
    assert all(abs(taken[s] - target[s]) <= max(12, 0.01 * target[s]) for s in size)


def test_mixed_documents_repeat_rows(docs):
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(docs).collect()}
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect()) == Counter({k: v for k, v in copies.items() if v})


def test_shards_are_even_and_gapless(docs, rows):
    got = sharding.shard_documents(docs, n_shards=7).collect()
    assert len(got) == len(rows)
    total, slots, size = Counter(), defaultdict(list), sum(len(t) + 8 for _, t, _ in rows)
    for r in got:
        assert r["shard_size"] == len(r["text"].encode()) + 8
        total[r["shard"]] += r["shard_size"]
        slots[r["shard"]].append(r["shard_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(abs(total[k] - size / 7) for k in range(7)) <= max(len(t) + 8 for _, t, _ in rows)


def test_word_and_window_hashes_are_of_the_words():
    import pyarrow as pa

    texts = ["a b  a b c", None, "", " x\x0by\x1cz ", "é é", "long " * 700_000 + "x" * 2_000_000 + " end"]
    got = dict(tokens.word_hashes(pa.array(texts)))
    assert sorted(got) == list(range(len(texts)))
    known: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert len(words) == len(got[i])
        for w, h in list(zip(words, got[i].tolist(), strict=True))[:50] + list(zip(words, got[i].tolist(), strict=True))[-3:]:
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    w = got[5][:100]
    assert len(set(tokens.windows(w, 5).tolist())) == 1 and len(tokens.windows(w[:3], 5)) == 1


def test_jaccard_join_is_brute_force(docs, rows):
    sets = {}
    for i, t, _ in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    parent, links = {i: i for i in sets}, Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_join(docs).collect()}
    assert got == {i: (top(i), links[i]) for i in ids}


def test_large_buckets_split_and_block(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    rng = random.Random(4)
    base, passage, rows = rng.choices(VOCABULARY, k=150), rng.choices(VOCABULARY, k=60), []
    for i in range(40):  # near copies of one text
        words = list(base)
        words[rng.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(rng.choices(VOCABULARY, k=150) + passage)) for i in range(40)]  # strangers with one passage
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    want = {a: sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    assert {i: n for i, (_, n) in got.items()} == want
    assert all(got[i][0] == i for i in range(100, 140))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_are_brute_force(spark, seed):
    rows = [(i, t) for i, t, _ in corpus(10 + seed, 80)] + [(500, "again " * 90), (501, "again " * 25), (None, "again " * 30)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), digest=True).collect()
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w, gone = t.split(), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if g in seen else set()
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


@pytest.mark.parametrize("chunk", [3, 17, 1 << 18])
def test_words_are_cut_in_pieces(monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(200):
        n = rng.randrange(120)
        body = "".join(rng.choice(["ab", "c\x1c", "é", " x"]) + rng.choice([" ", "\n", "\t \r", "\x0b"]) for _ in range(n))
        spans = [] if n < 20 else [(at := rng.randrange(n - 19), rng.randrange(1, n - 18 - at)) for _ in range(rng.randrange(4))]
        copy = rng.random() < 0.2
        gone = [n >= 20 if copy else any(a <= i < a + c + 19 for a, c in spans) for i in range(n)]
        want = b" ".join(w for w, g in zip(body.encode().split(), gone, strict=True) if not g).decode()
        packed = None if copy or not spans else [(a << 32) + c for a, c in spans]
        batch = pa.RecordBatch.from_pydict({"rest": [5], "body": [body], "copy": [copy], "spans": pa.array([packed], pa.list_(pa.int64()))})
        (text,), (digest,) = substrings._cut(iter([batch])), substrings._cut_digest(iter([batch]))
        assert text.to_pylist() == [{"rest": 5, "n_words": n, "n_removed": sum(gone), "kept_text": want}]
        assert digest.to_pylist()[0]["kept_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_base_statistics(spark):
    rows = [(1, "a b c a b c x"), (2, "l1\nl2\nl1\n \nl1\r"), (3, "#a $b |"), (4, None), (5, "é\x1c b"), (6, "q q q q q")]
    got = {r["i"]: r for r in rules.base_statistics(spark.createDataFrame(rows, "i int, text string"), "text").collect()}
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["n_repeat_words"]) == (7, 7, 6)
    assert (got[2]["n_dup_lines"], got[3]["n_symbols"], got[4]["n_words"], got[6]["n_repeat_words"]) == (1, 3, 0, 5)
    assert got[5]["word_chars"] == 3


def test_boilerplate_depletes(spark):
    menu = "\n".join(" ".join(f"m{chr(97 + i)}{chr(97 + k)}" for k in range(7)) for i in range(20))
    own = lambda i: " ".join(chr(97 + i // 26) + chr(97 + i % 26) + chr(97 + k // 26) + chr(97 + k % 26) for k in range(60))
    rows = [(i, f"{own(i)}\n{menu}", "h") for i in range(30)] + [(100 + i, own(100 + i), "h") for i in range(30)] + [(200, f"{own(200)}\n{menu}", "other")] + [(300 + i, own(300), "copies") for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(30))
    assert all(v for k, v in got.items() if k >= 100)


def test_templates_catch_new_parameters(spark):
    item = "A train leaves Paris at 9 with 120 people and travels 300 km to reach Lyon where 40 people leave and how many of the 120 people remain on it"
    renamed = "so then: A train leaves Rome at 7 with 250 people and travels 90 miles to reach Milan where 11 people leave and how many of the 250 people remain on it and so on"
    clash = "so then: A train leaves Rome at 7 with 250 people and travels 90 miles to reach Milan where 11 people leave and how many of the 251 people remain on it and so on"
    rows = [(1, item), (2, renamed), (3, clash), (4, "A train leaves Paris at 9 with nobody"), (5, None), (6, item.upper()), (7, "| " + item.replace(" ", " | "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, "What is 3 plus 4 ?")], "item_id long, text string")
    got = {r["doc_id"]: r["leaked_items"] for r in decontamination.flag_leaks(docs, bench).collect()}
    assert got[1] == got[2] == got[7] == [9] and got[3] == got[4] == got[5] == []
    assert sorted(r["doc_id"] for r in decontamination.drop_leaks(docs, bench).collect()) == sorted(i for i, v in got.items() if not v)


def test_surrogates_keep_form_identity_and_difference(spark):
    rows = [
        (1, "Mail Mr. John Smith at john.smith@acme.com or +1 (663) 555-6869, again +16635556869; card 4111 1111 1111 1111 and 4111-1111-1111-1111."),
        (2, "Mrs. Mary Smith, Dr. Smith and Иван Петров; JOHN.SMITH@ACME.COM, DE89 3704 0044 0532 0130 00, 10.0.3.4"),
        (3, "nothing here but version 2.0, 555 apples and 12-05."),
    ]
    got = {r["doc_id"]: r for r in pii.surrogate(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    one, two = got[1]["text"], got[2]["text"]
    assert got[3]["text"] == rows[2][1] and got[3]["pii_entities"] == 0
    for old in ("John", "Smith", "john.smith", "acme", "663", "4111 1111", "Mary", "Петров", "JOHN.SMITH", "3704", "10.0.3.4"):
        assert old not in one + two
    import re

    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", one)[0]
    assert "+1" + "".join(phones) in one
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", one)
    digits = [int(c) for c in re.sub(r"\D", "", cards[0])]
    assert cards[0].replace(" ", "-") == cards[1] and sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    surname = re.search(r"Mr\. \w+ (\w+)", one)[1]
    assert f"Dr. {surname}" in two and two.startswith("Mrs. ") and re.search(r"[А-Я][а-я]+ [А-Я][а-я]+", two)
    assert re.search(r"[a-z.]+@\S+", one)[0].upper() in two
    iban = re.sub(" ", "", re.search(r"DE\d\d(?: \d{4}){4} \d\d", two)[0])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_surrogate_clashes_are_resolved(spark, monkeypatch):
    plain = pii.new_norm
    crowded = lambda kind, norm, attempt, secret: F.when((kind == "ssn") & (attempt < 3), F.lit("111111111")).otherwise(plain(kind, norm, attempt, secret))
    monkeypatch.setattr(pii, "new_norm", crowded)
    rows = [(i, f"number {100 + i}-22-3333 twice {100 + i}-22-3333") for i in range(6)]
    got = [r["text"].split() for r in pii.surrogate(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()]
    assert all(x[1] == x[3] for x in got) and len({x[1] for x in got}) == 6


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home search"><header>Site</header><nav><a href=/>Menu</a></nav>
    <div class="cookie-notice"><p>We use cookies a lot on this site, do accept them please.</p></div><div class="wrap has-sidebar"><article><h1>Head &amp; line</h1><p>First   <b>bold</b>
    text<br>goes on<p>Short.<ul><li>one<li>two</ul><aside>Aside text</aside><form><input><button>Go</button></form><div class=ad>Buy this now</div></article>
    <div id="comments"><article><p>Reader says a long and winding thing that nobody asked for at all.</p></article></div><div class="sidebar">Links</div></div><footer>&copy; x</footer><script>var a="</p>";</script></body>"""
    assert html.extract(page) == "Head & line\nFirst bold text goes on\nShort.\none\ntwo"
    bare = "<body><div><a href=x>a</a> <a href=y>b</a></div><div>" + "<p>A paragraph of plain words that goes on for a while, as text does.</p>" * 6 + "</div><div><a href=z>c</a></div></body>"
    assert html.extract(bare).count("\n") == 5 and "a b" not in html.extract(bare)
