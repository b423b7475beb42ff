"""The ten operators on small tables with nulls, empty and repeated rows, clashing columns, against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import components, decontamination, fingerprints, language, mixing, sharding, simhash, suffixes, token_counts, toxicity, urls
from tidemark.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 120)), rng.choice(["a", "b", None]), rng.choice(["s0", "s0", "s1", "s2", None])) for i in range(60)]
    rows += [(100, None, "a", "s0"), (101, "", "a", "s1"), (102, rows[3][1], "b", "s0"), (103, rows[3][1], "b", None), (7, rows[7][1], rows[7][2], rows[7][3]), (None, "one two three four five six", "a", "s2"), (104, words(rng, 30_000), "a", "s0")]
    return make(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1. Mixing


def mixed_by_hand(rows, weights=(5, 2, 1), epochs=3):
    size = lambda t: len((t or "").encode().split())
    key = lambda d: hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, set(names)
    while left:  # share, cap, share the excess again
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > epochs * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        target |= {s: epochs * sizes[s] for s in over}
        left -= over
    copies = []
    for s in names:
        served = 0
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (key(r[0]), -1 if r[0] is None else r[0], size(r[1])))
        for d, t, _, _ in own:
            served += size(t)
            if size(t) and target[s]:
                copies += [((e * sizes[s] + served) / target[s], key(d), -1 if d is None else d, served, e, size(t)) for e in range(epochs)]
    taken, used = Counter(), 0
    for c in sorted(copies):
        used += c[5]
        if used > total:
            break
        taken[c[2]] += c[5]
    return target, taken, sizes


def test_mixing_matches_a_simulation(corpus):
    docs, rows = corpus
    target, taken, sizes = mixed_by_hand(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sums = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"]
        sums[-1 if r["doc_id"] is None else r["doc_id"]] += r["taken"]
    assert sums == Counter({k: taken[k] for k in sums})
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)


def test_mixing_of_nothing(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


# 2. URL filters


def test_urls_match_a_plain_reading(spark):
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "xexample.org", "org", "foo.com", "com", "de", ""]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12?x", "/en/2#f", "/fr/", "/de/9", "?q=/es/", "/es"]
    given_urls = [f"{p}{h}{q}" for p in ("http://", "https://", "") for h in hosts for q in paths] + [None, "", "://", "http://a//b://c"]
    pages = spark.createDataFrame(list(enumerate(given_urls)), "page_id long, url string")
    rules = spark.createDataFrame(Q.RULES, "host string, path string, verdict string")

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.split(c, 1)[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in Q.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for limit in (urls.MAX_LOCAL_RULES, 2):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules, max_local_rules=limit).collect()}
        assert got == {i: plain(u) for i, u in enumerate(given_urls)}
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


# 3. Fingerprints


def test_fingerprints_follow_the_next_document(corpus, empty):
    docs, rows = corpus
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for ranges in (1, 5):
        got = fingerprints.fingerprints(docs, ranges=ranges).collect()
        assert len(got) == len(rows)
        by_id = defaultdict(list)
        for r in got:
            by_id["null" if r["doc_id"] is None else r["doc_id"]].append(r)
        for (i, t, _, _), (_, u, _, _) in zip(order, order[1:] + order[:1], strict=True):
            t, u, name = t or "", u or "", "null" if i is None else i
            if len(by_id[name]) > 1:
                continue  # repeated ids: in the order of their texts
            r = by_id[name][0]
            new = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert r["fingerprint"] == fingerprints.digest(t.encode()).tobytes().hex()
            assert r["near_edited"] == fingerprints.likeness(fingerprints.digest(t.encode()), fingerprints.digest(new.encode()))
            assert r["near_next"] == fingerprints.likeness(fingerprints.digest(t.encode()), fingerprints.digest(u.encode()))
            assert 0 <= r["near_next"] <= 1
        assert by_id[102][0]["fingerprint"] == by_id[103][0]["fingerprint"]
    assert fingerprints.fingerprints(empty).count() == 0


@given(st.binary(max_size=400), st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = fingerprints.digest(a), fingerprints.digest(b)
    assert fingerprints.likeness(x, x) == 1
    assert 0 <= fingerprints.likeness(x, y) == fingerprints.likeness(y, x) <= 1
    plain = Counter()
    for i in range(len(a) - 2):
        plain[((a[i] << 16 | a[i + 1] << 8 | a[i + 2]) * 2654435761 % 2**32) >> 25] += 1
    assert fingerprints.counts(a).tolist() == [plain[i] for i in range(128)]


# 4. Token counts


def test_rollup_equals_a_recount_and_batches_are_idempotent(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    schema = "source string, lang string, tokenizer string, tokens long"
    first = spark.createDataFrame([("a", "x", "1", 5), ("a", "x", "1", 7), (None, "y", "1", 1)], schema)
    again = spark.createDataFrame([("a", "x", "2", 9, "1", 7)], schema + ", old_tokenizer string, old_tokens long")
    assert rollup.commit("0", token_counts.inserted(first))
    assert not rollup.commit("0", token_counts.inserted(first))
    assert rollup.commit("1", token_counts.revised(again))
    assert rollup.commit("2", token_counts.deleted(first.filter("source IS NULL")))
    want = {("a", "x", "1", 1, 5), ("a", "x", "2", 1, 9)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert {tuple(r) for r in rollup.totals().collect()} == want
    assert not rollup.commit("1", token_counts.revised(again))
    rollup.commit("3", token_counts.inserted(first.limit(1)))
    assert sum(r["documents"] for r in rollup.totals().collect()) == 3


def test_token_counters(spark):
    from pyspark.sql import functions as F

    texts = ["", None, " a b\tc\n", "it's 3.5!", "été—x", "\u00a0"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(token_counts.word_tokens(F.col("text")), token_counts.piece_tokens(F.col("text"))).collect()
    assert [r[0] for r in got] == [0, 0, 3, 2, 1, 1]
    assert [r[1] for r in got] == [0, 0, 3, 7, 3, 1]


def test_bpe_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(token_counts.bpe_tokens(F.col("text"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)).collect()]
    assert got == [2, 0, 0]


# 5. Decontamination


def contained_by_hand(docs, items, n=5, threshold=0.8):
    import regex

    shingles = lambda t: {tuple(w[i : i + n]) for w in [regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())] for i in range(len(w) - n + 1)}
    out = Counter()
    for (i, t), (j, u) in itertools.product(docs, items):
        own = shingles(u)
        if own and len(own & shingles(t)) >= threshold * len(own):
            out[(i, j)] += 1
    return out


def test_decontamination_finds_all_leaks(spark, empty):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randrange(6, 60), 5000)) for i in range(25)] + [(30, "too short"), (31, None), (32, "")]
    rows = [(i, words(rng, rng.randrange(1, 2000), 5000), "a", "s") for i in range(30)]
    for i, (_, t) in enumerate(items[:20]):
        part = t.split()
        part = part[: len(part) if i % 3 else max(5, round(len(part) * rng.random()))]
        rows.append((100 + i, f"{words(rng, rng.randrange(0, 3000), 5000)} {' '.join(part).upper()}, {words(rng, 50, 5000)}", "a", "s"))
    rows += [(200, None, "a", "s"), (201, "", "a", "s"), (202, rows[31][1], "a", "s")]
    docs = make(spark, rows).selectExpr("*", "1 AS text_key", "2 AS shared")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contained_by_hand([r[:2] for r in rows], items)
    assert len(want) >= 15
    assert Counter((r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, bench).collect()) == want
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert decontamination.contained(empty, bench).count() == 0 and decontamination.contained(docs, bench.limit(0)).count() == 0


# 6. Sharding


def test_sharding_moves_rows_only_into_the_new_shard(spark, corpus, empty):
    docs, rows = corpus
    ids = spark.range(3000).withColumnRenamed("id", "doc_id").unionByName(docs.select("doc_id"))
    both = sharding.assign(sharding.assign(ids, "doc_id", [1.0] * 10), "doc_id", [1.0] * 11, "grown")
    got = sharding.with_slots(both, "doc_id").collect()
    assert all(r["grown"] in (r["shard"], 10) for r in got)
    assert 150 < sum(r["grown"] == 10 for r in got) < 450
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    heavy = Counter(r["shard"] for r in sharding.assign(ids, "doc_id", [3.0, 1.0, 0.0]).collect())
    assert heavy[2] == 0 and 2.5 < heavy[0] / heavy[1] < 3.6
    assert sharding.with_slots(sharding.assign(empty, "doc_id", [1.0, 1.0]), "doc_id").count() == 0


def test_shards_are_written_whole(spark, corpus, tmp_path):
    docs, rows = corpus
    sharding.write_shards(docs, "doc_id", [1.0] * 4, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


# 7. Language


def test_languages_are_told_apart(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = Q.op7_language(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    model = language.fit(docs)
    odd = make(spark, [(1, None, "a", "s"), (2, "", "a", "s"), (3, "12 34 !?", "a", "s"), (4, "the of and", "a", "s"), (5, "".join(chr(0x4E00 + i * 7) for i in range(300)), "a", "s")])
    judged = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [judged[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(judged[i]["lang_rejected"] for i in (1, 2, 3, 5))
    assert language.known(docs, model).columns == docs.columns
    assert language.known(docs, model).count() >= 0.98 * len(truth)
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


# 8. SimHash


def fingerprint_by_hand(text, n=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_by_hand(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_fingerprints_by_the_contract(corpus, spark):
    docs, rows = corpus
    got = simhash.groups(docs).collect()
    assert len(got) == len(rows)
    fps = {i: fingerprint_by_hand(t) for i, t, _, _ in rows}
    own = groups_by_hand(list(fps.values()))
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[own[f]] = min(least.get(own[f], i), i)
    for r in got:
        assert r["fp"] % 2**64 == fps[r["doc_id"]]
        assert r["component_id"] == least.get(own[fps[r["doc_id"]]])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({least[own[f]] for i, f in fps.items() if i is not None})


@pytest.mark.parametrize("crowd", [20_000, 4])
def test_links_lose_no_pair_and_connect_no_other(spark, crowd):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:25]:  # chains, dense balls, and pairs just beyond the limit
        for _ in range(6):
            for k in (1, 3, 4):
                fps.add(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    fps = sorted(fps)
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), crowd=crowd).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 3 for r in edges)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components.components(spark.createDataFrame(edges)).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for f, r in groups_by_hand(fps).items():
        mine[r].add(f)
    for f in fps:
        theirs[roots.get(f, f)].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_of_nothing(empty):
    assert simhash.groups(empty).count() == 0


# 9. Toxicity


def test_automaton_accepts_exactly_what_is_near():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    entries = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(30)]
    root = toxicity.trie(entries)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
        for edits in (0, 1, 2):
            near = [e for e in entries if distance(word, e) <= edits]
            assert toxicity.intersect(toxicity.Automaton(word, edits), root) == min(near, default=None)


def test_misspelled_words_and_quotes():
    lexicon = toxicity.Lexicon({"moron": 2.0, "scum": 1.0}, {"idio": 3.0})
    got = dict(zip(toxicity.FEATURES, toxicity.features('a m0ron, idiotic scum ' + "x " * 20 + 'he said "the moron" ' + "x " * 20 + "moroon", lexicon), strict=True))
    assert got["exact"] == pytest.approx(np.log1p(4.0)) and got["exact_quoted"] == pytest.approx(np.log1p(2.0))
    assert got["fuzzy"] == pytest.approx(np.log1p(4.0)) and got["fuzzy_quoted"] == 0
    assert lexicon.match("scam") is None and lexicon.match("table") is None
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == [0.0] * 5


def test_toxic_documents_are_found(spark, sf_dir, empty):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Q.op9_toxicity(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert labels
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs.limit(3), none).collect()} == {0.0}


# 10. Suffix arrays


@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)))
@settings(max_examples=150, deadline=None)
def test_suffix_array_is_sorted(text):
    assert suffixes.suffix_array(text, 1000).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def kept_by_hand(rows, length):
    data = [((t or "").encode()) for _, t, _, _ in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((len(d), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(d, mask, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [50_000, 1])
def test_repeats_are_removed_exactly(spark, corpus, crowd):
    rng = random.Random(8)
    passage, other = words(rng, 90), words(rng, 60)
    rows = [*corpus[1][:40], *corpus[1][-7:-1]]
    rows += [(300 + i, f"{words(rng, 20)} {passage[: rng.randrange(150, len(passage))]} {words(rng, 20)} {other}é{words(rng, 9)}", "a", "s") for i in range(12)]
    rows += [(400, "ab" * 400, "a", "s"), (401, f"{other} {words(rng, 50)} {other}", "a", "s"), (402, "é" * 99, "a", "s"), (403, "x" * 199, "a", "s"), (404, "x" * 199, "a", "s"), (405, "y" * 200, "a", "s")]
    docs = make(spark, rows)
    for length in (200, 64):
        got = suffixes.without_repeats(docs, length=length, crowd=crowd).collect()
        mine = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
        assert mine == Counter((r[0], *k) for r, k in zip(rows, kept_by_hand(rows, length), strict=True))
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_repeats_in_very_long_texts():
    rng = random.Random(4)
    unique = bytes(rng.choice(b"abcdefgh") for _ in range(2_200_000))
    a, b, at = suffixes.anchors(unique)
    starts = (at >> 16).tolist()
    ends = ((at >> 16) + (at & 0xFFFF)).tolist()
    assert starts[0] == 0 and ends[-1] == len(unique) - 200 and all(e + 1 == s for e, s in zip(ends[:-1], starts[1:], strict=True))


def test_repeats_of_nothing(empty):
    assert suffixes.without_repeats(empty).count() == 0
