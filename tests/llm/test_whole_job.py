"""Cases that an earlier form of an operator lost."""
import itertools
import random

from folioforge.llm import linkage, names, queries, repeated, scans
from tests.llm.test_operators import REF, TRUTH


# ---- 6
def test_slip_in_a_common_word_moves_no_block_out_of_reach(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4))
    tails = [" ".join(word() for _ in range(5)) for _ in range(40)]
    truth = spark.createDataFrame([(i, None, [f"Quentin {word()}"], f"Evidence {t}", 2001, 9) for i, t in enumerate(tails)], TRUTH)
    slips = ["Eyidence", "Evdience", "Evidnece of thee"]
    refs = spark.createDataFrame([(i, "h", 1, 0, None, None, None, 2001, None, f"{slips[i % 3]} {tails[i]}", 9, 9) for i in range(30)], REF)
    labels = spark.createDataFrame([], "ref_id bigint, truth_id bigint, is_match int")
    got = {(r.ref_id, r.truth_id) for r in linkage.matches(refs, truth, labels).collect()}
    assert got == {(i, i) for i in range(30)}


# ---- 2
def test_short_surname_behind_long_given_names(spark):
    pairs = [("Alexander William Ford", "Ford, A W"), ("Katherine Elizabeth Wong", "Wong, K E"), ("Jennifer Margaret Smith", "Smith, J M")]
    people = [n for p in pairs for n in p]
    rng = random.Random(7)
    for i in range(300):  # the given names and initials are common, the surnames are not
        s = "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4))
        people.append(f"{pairs[i % 3][0].rsplit(' ', 1)[0]} {s}" if i % 2 else f"{s}x, {pairs[i % 3][1].split(', ')[1]}")
    keys = [names.fold(x) for x in people]
    df = spark.createDataFrame(list(enumerate(keys)), "id bigint, key string")
    got = {(r.a, r.b) for r in names.linked_pairs(df).collect()}
    assert {(0, 1), (2, 3), (4, 5)} <= got


def test_signatures_of_all_similar_names_are_near():
    rng = random.Random(3)
    base = ["Quentin D. Zarubamel", "Zarubamel, Q. D.", "Quentin de Zarubamel", "Q. Ford", "Ann Ford", "WHO Genva", "World Health Office, Genva", "Institute of Soil and Water", "Inst. of Soil and Water", "UN WHO", "Bob Zarubamel", "Robert Zarubamel", "R. Zarubamel", "Zarubamel", "Bill Fordham", "William Fordham", "Fordham W"]
    keys = []
    for x in base:
        keys.append(names.fold(x))
        for _ in range(25):
            i = rng.randrange(len(x) - 1)
            keys.append(names.fold(rng.choice([x[:i] + x[i + 1:], x[:i] + x[i + 1] + x[i] + x[i + 2:], x[:i] + rng.choice("abcxyz") + x[i:]])))
    keys = [k for k in keys if k]
    bits = [names.signature(k) for k in keys]
    given = lambda x, k: x[3] >> 32 * k & 0xFFFFFFFF
    near = lambda a, b: any(a[i] is not None and b[j] is not None and (a[i] ^ b[j]).bit_count() <= names.SLIP_BITS and given(a, i) & given(b, j) for i in range(2) for j in range(2)) or None not in (a[2], b[2]) and (min(a[2], b[2]) < 0 or (a[2] ^ b[2]).bit_count() <= names.SLIP_BITS)
    similar = [(a, b) for i, a in enumerate(keys) for j, b in enumerate(keys[:i]) if names.similarity(a, b) > 0 and not near(bits[i], bits[j])]
    assert not similar


def test_candidates_hold_all_similar_names(spark, monkeypatch):
    rng = random.Random(21)
    base = ["Quentin D. Zarubamel", "Zarubamel, Q. D.", "Q. Zarubamel", "Zarubamel", "Bob Zarubamel", "R. Zarubamel", "Robert Leonard", "Leonard, Rob", "Leonard S", "Leonard Staflepi", "Staflepi, L.", "Ford A W", "Alexander William Ford",
            "Ford, Sandy", "Zarubamel JB", "J. B. Zarubamel", "Institute of Soil and Water, Genvatiwald", "Inst. of Soil and Water, Genvatiwald", "ISW Genvatiwald", "ISW Genva Tiwald", "Institute of Soil and Water, Genva Tiwald",
            "Univ. of Genvatiwald", "University of Genvatiwald", "Institute of Water", "Inst. of Water", "Institute of Wtr", "Research Council of Materials", "RCM"]
    keys = {names.fold(x) for x in base}
    for x in base:
        for _ in range(12):
            i = rng.randrange(len(x) - 1)
            keys.add(names.fold(rng.choice([x[:i] + x[i + 1:], x[:i] + x[i + 1] + x[i] + x[i + 2:], x[:i] + rng.choice("abcxyz") + x[i:]])))
    text = sorted(k for k in keys if names.grams(k))
    want = {(i, j) for j in range(len(text)) for i in range(j) if names.similarity(text[i], text[j]) > 0}
    df = spark.createDataFrame(list(enumerate(text)), "id bigint, key string")
    for hot, sample, block in ((200, 8, 2000), (0, 1, 3), (8, 2, 5)):  # no key, every key and some keys are split
        monkeypatch.setattr(names, "HOT", hot), monkeypatch.setattr(names, "SAMPLE", sample), monkeypatch.setattr(names, "WORD_BLOCK", block)
        got = {(r.a, r.b) for r in names.candidates(df).collect()}
        assert want <= got and all(a < b for a, b in got)
    assert names.candidates(df.limit(0)).count() == 0


def test_candidates_grow_with_the_table(spark, monkeypatch):
    # endings, given names and words of organisations are shared by all, surnames and places by few
    monkeypatch.setattr(names, "HOT", 40), monkeypatch.setattr(names, "SAMPLE", 2)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(5))
    forms = ("Leonard {}tiwald", "L. {}tiwald", "Leonard W. {}tiwald", "{}tiwald, L.", "Institute of Soil and Water, {}tiwald", "Inst. of Soil and Water, {}tiwald")

    def count(n: int) -> int:
        keys = [names.fold(f.format(w.capitalize())) for w in (word() for _ in range(n)) for f in forms]
        return names.candidates(spark.createDataFrame(list(enumerate(keys)), "id bigint, key string")).count()

    few, many = count(100), count(800)
    assert 7 * 100 <= few and many < 12 * few


def test_entities_do_not_depend_on_the_size_of_a_component(spark, monkeypatch):
    # a slip shares no gram with the name it is of, only the initial links both
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(n))
    given = [c + word(4)[1:] for c in "BDFG"]
    people = [f(g) for g in given for f in (lambda g: f"{g} Zarubamel", lambda g: f"{g[:3]}{g[4]}{g[3]}{g[5:]} Zarubamel", lambda g: f"{g[0]}. Zarubamel")]
    others = [f"{'BDFG'[i % 4]}. {word(4)}" for i in range(600)]
    df = spark.createDataFrame([(p,) for p in people + others], "author string")

    def found(full: int) -> set[frozenset]:
        monkeypatch.setattr(names, "FULL_COMPARISON", full)
        groups: dict = {}
        for r in names.entities(df).collect():
            groups.setdefault(r.entity, set()).add(r.name)
        return {frozenset(g) for g in groups.values()}

    monkeypatch.setattr(names, "BLOCK", 2, raising=False)
    assert found(2) == found(100_000) and {frozenset(people[i:i + 3]) for i in range(0, 12, 3)} <= found(2)


def test_linkage_in_rounds_equals_one_pair_at_a_time(spark):
    rng = random.Random(12)
    for n, share in ((6, 0.8), (40, 0.3), (60, 0.1)):
        links = [(i, j, rng.choice([0.5, 0.7, 0.9]) if n == 6 else rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < share]
        label = names.average_linkage(n, links, 0.4)
        want: dict = {}
        for i in {x for a, b, _ in links for x in (a, b)}:
            want.setdefault(label[i], set()).add(i)
        got: dict = {}
        for r in names.linkage_rounds(spark.createDataFrame(links, "a bigint, b bigint, sim double"), 0.4).collect():
            got.setdefault(r.entity, set()).add(r.id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert names.linkage_rounds(spark.createDataFrame([], "a bigint, b bigint, sim double")).count() == 0


# ---- 1
def test_the_vectors_tell_a_misreading_from_a_word_that_looks_like_one(spark):
    rng = random.Random(6)
    fill = ["river", "basin", "upper", "lower", "chronic", "renal", "viral", "kelp", "coastal", "transect"]
    rows = []
    for i in range(400):
        a, b, c, d = rng.sample(fill, 4)
        rows.append(f"the {a} notes and the {b} notes were kept, a semi {'arid' if i % 8 == 0 else c} plain lay north, {d} counts among {a} counts rose")
    rows += [f"the {rng.choice(fill)} counts amonq {rng.choice(fill)} counts rose" for _ in range(12)]  # frequent, yet misread
    chunks = spark.createDataFrame([(i, "h", 1, i, t, None) for i, t in enumerate(rows)], "chunk_id bigint, doc_hash string, page int, idx int, text string, title string")
    refs = spark.createDataFrame([], "ref_id bigint, doc_hash string, raw string")
    model = scans.learn(chunks, refs)
    with_vectors, without = scans.Repairer(*model), scans.Repairer(*model[:4])
    assert with_vectors.repair("a semi arid plain", ()) == (False, "a semi arid plain") and without.repair("a semi arid plain", ())[0]
    assert with_vectors.repair("the viral counts amonq renal counts rose", ()) == (True, "the viral counts among renal counts rose")


def test_numbers_in_brackets_are_page_numbers_by_the_papers_other_ones(spark):
    rows = [(1, "h", 3, "one\n103\ntwo"), (2, "h", 4, "one\n[104]\ntwo"), (3, "h", 5, "one\n[12]\ntwo"), (4, "g", 9, "one\n[2]\ntwo"), (5, "h", 6, "one\n106\ntwo"), (6, None, None, "one\n[7]\ntwo"), (7, "h", None, None)]
    chunks = spark.createDataFrame([(*r, None) for r in rows], "chunk_id bigint, doc_hash string, page int, text string, title string")
    refs = spark.createDataFrame([], "ref_id bigint, doc_hash string, page int, raw string")
    man = spark.createDataFrame([], "doc_hash string, title string")
    got = {r.row_id: r.affected for r in scans.repaired(chunks, refs, man).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}


# ---- 3
def test_sequences_equal_a_brute_force_search(spark):
    rng = random.Random(11)
    notices = [f"notice {c} of the house about its own terms" for c in ("one", "two", "three", "four", "five")] + ["all rights", "see terms"]
    rows, man = [], []
    for paper in range(24):
        pub = ("North", "South", None)[paper % 3]
        man += [(f"h{paper}", pub), (f"h{paper}", pub if paper % 2 else None)]
        for idx in range(3):
            own = [f"body words {paper} {idx} {rng.choice(['kelp', 'reef', 'moss', 'fjord'])} are different {rng.random()} lines here {'abcdefgh'[paper % 8]}{'xyzuvw'[idx]}"]
            start = rng.randrange(len(notices))
            rows.append((paper * 10 + idx, f"h{paper}", idx, "\n".join(notices[start:start + rng.randint(0, 5)] + own)))
    rows += [(900, "h0", 9, None), (901, "h0", 10, ""), (902, None, 0, notices[0])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_hash string, idx int, text string")
    r = repeated.Repeated(chunks, spark.createDataFrame(man, "doc_hash string, publisher string"), min_papers=2, min_share=0.1)
    pub_of = {h: p for h, p in man if p}
    papers: dict = {}
    for i, h, idx, t in sorted(rows, key=lambda x: (x[1] or "", x[2])):
        if h in pub_of:
            seq = papers.setdefault((pub_of[h], h), [])
            seq += [x for x in (t or "").split("\n") if x]

    def support(sequences):
        n: dict = {}
        for (p, h), seq in sequences.items():
            seen = {tuple(seq[i:j]) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)}
            for x in seen:
                n[p, x] = n.get((p, x), 0) + 1
        return {k: v for k, v in n.items() if v >= 2 and v >= 0.1 * sum(1 for q, _ in sequences if q == k[0])}

    single = {k for k in support({k: list(v) for k, v in papers.items()}) if len(k[1]) == 1}
    want = support({(p, h): list(dict.fromkeys(x for x in seq if (p, (x,)) in single)) for (p, h), seq in papers.items()})
    got = [(x.publisher, len(x.pattern), x.papers) for x in r.patterns().collect()]
    assert sorted(got) == sorted((p, len(x), n) for (p, x), n in want.items()) and max(n for _, n, _ in got) >= 4
    short = {(p, x) for (p, seq) in want if any(len(y.split()) >= 5 for y in seq) for x in seq}
    lines = {(i, k) for i, h, _, t in rows if h in pub_of for k, x in enumerate((t or "").split("\n"), 1) if (pub_of[h], x) in short}
    assert {(x.chunk_id, x.line_no) for x in r.found().collect()} == lines
    assert {(x.chunk_id, x.line_no) for x in r.found(short=False).collect()} == {(i, k) for i, k in lines if len(next(t for j, _, _, t in rows if j == i).split("\n")[k - 1].split()) >= 5}


def test_other_lines_may_stand_between_those_of_a_pattern(spark, tmp_path):
    a, b, c, d = (f"{x} belongs to the notices of this house" for x in ("alpha", "beta", "gamma", "delta"))
    papers = [[a, c], [a, b, c], [a, "own words here", b, c], [a, b, d, c], [d, a, c], [c, d], [c, a], [b, d], ["nothing of it", d], []]
    rows = [(i, f"h{i}", 0, "\n".join(p)) for i, p in enumerate(papers)]
    spark.createDataFrame(rows, "chunk_id bigint, doc_hash string, idx int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(f"h{i}", "North") for i in range(len(papers))], "doc_hash string, publisher string").write.parquet(str(tmp_path / "manifest_item.parquet"))
    n: dict = {}
    for p in papers:
        seq = [x for x in p if x in (a, b, c, d)]
        for x in {x for k in range(1, len(seq) + 1) for x in itertools.combinations(seq, k)}:
            n[x] = n.get(x, 0) + 1
    want = {x: k for x, k in n.items() if k >= 3}
    assert want[a, c] == 5 and want[a, b, c] == 3
    got = queries.QUERIES["p3_patterns"](spark, str(tmp_path)).collect()
    assert sorted((len(r.pattern), r.papers) for r in got) == sorted((len(x), k) for x, k in want.items())
    assert {tuple(r.pattern) for r in got} >= {tuple(r.pattern) for r in repeated.Repeated(spark.read.parquet(str(tmp_path / "chunks.parquet")), spark.read.parquet(str(tmp_path / "manifest_item.parquet"))).patterns().collect()}
