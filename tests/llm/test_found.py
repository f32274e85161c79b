"""The operators against brute force, round trips and stated cases."""

import random
import re

import pytest

from postmill.llm import copies, encoding, group_split, leakage, lookalike, near_dup, newtext, packing, personal, quality

WORDS = [a + b for a in ("bra", "tel", "mon", "quo", "fis", "lan", "gor", "pux") for b in ("dle", "kin", "vor", "stam", "rett", "ope")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- 2 ---------------------------------------------------------------------------------------------------------------------------


def brute_groups(rows, t=0.7):
    sets = {}
    for i, d, x in rows:
        n = near_dup.normalise(x)
        sets[i] = (d, {n[k : k + 5] for k in range(max(len(n) - 4, 1))} if n else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a][0] == sets[b][0]:
                x, y = sets[a][1], sets[b][1]
                if (len(x & y) / len(x | y) if x | y else 1) >= t:
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, i = [], 1
    for _ in range(25):
        base = sentence(rng, rng.choice([4, 12, 30, 90])).split()
        for _ in range(rng.randint(1, 6)):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            rows.append((i, rng.choice(["sms", "email"]), " ".join(edited).upper() if rng.random() < 0.3 else "  ".join(edited)))
            i += 1
    got = {r.id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "msg_id bigint, domain string, text string")).collect()}
    assert got == brute_groups(rows)


def test_hot_campaign_is_one_class(spark):
    rng = random.Random(3)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(1, 601):
        edited = list(base)
        edited[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((i, "email", " ".join(edited)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "msg_id bigint, domain string, text string"))
    assert [r.class_id for r in out.select("class_id").distinct().collect()] == [1]


def test_pairs_among_unlike_rows_of_one_bucket_are_found(spark, monkeypatch):
    def one_bucket(threshold):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([7] * b.num_rows, pa.int64()), pa.array([80] * b.num_rows, pa.int32())], names=["id", "bucket", "n"])

        return run

    monkeypatch.setattr(near_dup, "_sketcher", one_bucket)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)) for _ in range(60)]
    rows = [(k, "sms", x) for k, x in enumerate(texts, 1)] + [(60 + k, "sms", x + "xyz") for k, x in enumerate(texts[:30], 1)]
    rng.shuffle(rows)
    got = {r.id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "msg_id bigint, domain string, text string")).collect()}
    assert got == {k: k - 60 if k > 60 else k for k in range(1, 91)}


def test_buckets_are_paired_whatever_the_batches():
    import itertools

    import numpy as np
    import pyarrow as pa

    sizes = [1, 4, 2, 9, 3, 8, 30, 12, 1, 25]
    bucket, ids = np.repeat(np.arange(len(sizes)), sizes), np.arange(sum(sizes))
    runs = np.split(ids, np.cumsum(sizes)[:-1])
    want = set()
    for run in (r.tolist() for r in runs):
        want |= set(itertools.combinations(run, 2)) if len(run) <= near_dup.FULL else {(run[0], x) for x in run[1:]} | set(itertools.pairwise(run))
    want = {p for p in want if 3 not in p}  # a row of a tenth of the others' size
    for step in (1, 2, 3, 5, 7, 11, 26, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(bucket[k : k + step]), pa.array(ids[k : k + step]), pa.array(np.where(ids[k : k + step] == 3, 10, 100).astype(np.int32))], names=["bucket", "id", "n"]) for k in range(0, len(ids), step)]
        out = [r for b in near_dup._pairing(0.7)(iter(batches)) for r in b.to_pylist()]
        assert {(r["lo"], r["hi"]) for r in out if r["bucket"] is None} == want, step
        assert sorted((r["bucket"], r["hi"]) for r in out if r["bucket"] is not None) == [(int(b), int(k)) for b, k in zip(bucket, ids) if sizes[b] > near_dup.FULL]


def test_sketches_travel_in_small_packs_and_come_back_sorted(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(near_dup, "PACK", 5_000)
    monkeypatch.setattr(near_dup, "HOT", 40)
    rng = np.random.default_rng(3)
    bucket = rng.integers(-(1 << 63), (1 << 63) - 1, 4_000)[rng.integers(0, 4_000, 12_000)]
    bucket[::9], bucket[1::90] = bucket[0], bucket[1]  # a ninth of all rows in one bucket
    ids, n = np.arange(12_000) // 6 * 3 + 10**12, rng.integers(1, 2_000, 12_000).astype(np.int32)
    names = ["id", "bucket", "n"]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 700]) for x in (ids, bucket, n)], names=names) for k in range(0, 12_000, 700)]
    packs = [r for b in near_dup._packer(lambda x: x, 16)(iter(batches)) for r in b.to_pylist()]
    assert sum(len(r["rows"]) for r in packs) < 9 * 12_000 and any(r["hot"] is not None for r in packs)
    packs.sort(key=lambda r: (r["cell"], r["hot"] is not None, r["hot"] or 0))
    for step in (1, 3, 500):
        parts = [pa.RecordBatch.from_pylist(packs[k : k + step], pa.schema([("cell", pa.int32()), ("hot", pa.int64()), ("rows", pa.binary())])) for k in range(0, len(packs), step)]
        out = [r for b in near_dup._unpacked(iter(parts)) for r in b.to_pylist()]
        u = bucket.view(np.uint64)
        whole = ((u >> np.uint64(60) << np.uint64(32)) | (u & np.uint64(0xFFFFFFFF))).astype(np.int64)
        assert [r["bucket"] for r in out] == sorted(whole.tolist())
        assert sorted((r["bucket"], r["id"], r["n"]) for r in out) == sorted(zip(whole.tolist(), ids.tolist(), n.tolist()))
    monkeypatch.setattr(near_dup, "HOT", 900)  # more than the rows of a small pack, and less than twice as many
    assert {r["hot"] for b in near_dup._packer(lambda x: x, 16)(iter(batches[:1])) for r in b.to_pylist()} == {None}


def test_rows_that_no_pair_has_are_not_sent(spark):
    rows = spark.range(0, 20_000).selectExpr("id", "cast(id as string) AS text")
    kept = {r.id for r in near_dup._marked(rows, rows.filter("id % 50 = 7").select("id")).collect()}
    assert {k for k in range(20_000) if k % 50 == 7} <= kept and len(kept) < 3_000
    assert near_dup._marked(rows, rows.filter("id < 0").select("id")).count() == 0


def test_normal_texts_are_those_of_the_patterns():
    rng = random.Random(9)
    signs = " \t\n\x0b\x1c\x85\xa0\u2028\u3000\u200b\ufeffabXY019\u00b2\u0663\u096fİßǅ\U0001d7d9"
    for k in range(4_000):
        x = "".join(rng.choices(signs if k % 2 else signs[:5] + "abXY019", k=rng.randint(0, 9)))
        assert near_dup.normalise(x) == re.sub(r"\s+", " ", re.sub(r"\d", "0", x.lower())), ascii(x)


@pytest.mark.parametrize("seed", range(4))
def test_texts_that_share_a_sentence_do_not_meet_often(seed):
    import numpy as np

    rng = random.Random(seed)
    fill = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ", k=n))
    common = fill(120)
    texts = [fill(140) + common + fill(140) for _ in range(400)]
    who, bucket, _ = near_dup.sketch_parts(texts, np.zeros(len(texts), np.uint64), 0.7)
    met = np.unique(bucket, return_counts=True)[1]
    assert int((met * (met - 1) // 2).sum()) < 1_000


def test_copies_of_several_tasks_are_one(spark):
    rows = [(k, "sms", "the very same words, again and again" + "!" * (k % 2)) for k in range(400)] + [(400 + k, "email", f"no two of these {k * 7919} are {k * 104729} alike {chr(97 + k)}") for k in range(20)]
    df = spark.createDataFrame(rows, "msg_id bigint, domain string, text string").repartition(12)
    got = {r.id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_groups(rows)


def test_bit_sketches_bound_the_difference_and_fold():
    import numpy as np

    rng = random.Random(11)
    texts = ["", "ab", *(sentence(rng, k) for k in (3, 20, 21, 90, 300)), "x" * 40]
    n, bits = near_dup.bit_sketches(texts)
    sets = [{t[k : k + 5] for k in range(max(len(t) - 4, 1))} if t else set() for t in texts]
    assert n.tolist() == [len(x) for x in sets]
    for a in range(len(texts)):
        for b in range(len(texts)):
            both = np.array([len(sets[a])]), np.array([len(sets[b])])
            least = min(len(bits[a]), len(bits[b])) // 8
            apart = int(np.bitwise_count(near_dup._folded(near_dup._words([bits[a]]), least) ^ near_dup._folded(near_dup._words([bits[b]]), least)).sum())
            assert apart <= len(sets[a] ^ sets[b])
            like = (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1) >= 0.7
            assert near_dup.may_be_similar(both[0], [bits[a]], both[1], [bits[b]], 0.7)[0] or not like
    every = np.arange(len(texts))
    open_ = {(int(x), int(y)) for i, j in near_dup.close_pairs(every, every, n, bits, 0.7) for x, y in zip(i, j)}
    assert {(k, k) for k in range(len(texts))} <= open_ and (2, 6) not in open_


def test_parity_parts_bound_the_difference():
    import numpy as np

    rng = random.Random(5)
    a = sentence(rng, 80)
    b = a.replace(a.split()[3], "zzz", 1)
    who, bucket, _ = near_dup.sketch_parts([a, b], np.zeros(2, np.uint64), 0.7)
    shared = set(bucket[who == 0]) & set(bucket[who == 1])
    assert len(shared) >= near_dup.PARTS - 12


@pytest.mark.parametrize("length", [60, 150, 400, 1200, 2000])
@pytest.mark.parametrize("inserted", [False, True])
def test_links_at_the_threshold_are_met(length, inserted):
    import numpy as np

    rng = random.Random(length)
    fill = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ", k=n))
    texts = []
    for _ in range(200):
        a, m = fill(length), int(length * 0.295 / 1.705)
        texts += [a, a + fill(int(length * 0.295 / 0.705)) if inserted else a[: length // 2] + fill(m) + a[length // 2 + m :]]
    who, bucket, _ = near_dup.sketch_parts(texts, np.zeros(len(texts), np.uint64), 0.7)
    parts = [set() for _ in texts]
    for k, b in zip(who.tolist(), bucket.tolist()):
        parts[k].add(b)
    assert sum(not parts[k] & parts[k + 1] for k in range(0, 400, 2)) <= 4


# ---- 3 ---------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("paypal", "раураl", True), ("office", "oﬃce", True), ("ＦＲＥＥ", "FREE", True), ("café", "café", True), ("a b", "a b", True),
        ("a​b", "ab", True), ("co-op", "co‑op", True), ("a\r\nb", "a\nb", False), ("a\tb", "a b", False), ("a\tb", "a\u200b\tb", True), ("cafe", "café", False), ("a  b", "a b", False),
        ("Free", "free", False), ("“a”", '"a"', False), ("m²", "m2", False), ("a\n\nb", "a\nb", False),
    ],
)
def test_skeleton(a, b, same):
    assert (lookalike.skeleton(a) == lookalike.skeleton(b)) is same


def test_lookalike_pairs(spark):
    rows = [(1, "hello"), (2, "hеllo"), (3, "hello"), (4, "Hello"), (5, "hello​"), (6, "other")]
    got = {(r.a, r.b) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "msg_id bigint, text string")).collect()}
    assert got == {(1, 2), (1, 5), (2, 3), (2, 5), (3, 5)}
    classes = {(r.id, r.spelling_id, r.class_id) for r in lookalike.lookalike_classes(spark.createDataFrame(rows, "msg_id bigint, text string")).collect()}
    assert classes == {(1, 1, 1), (2, 2, 1), (3, 1, 1), (5, 5, 1)}


# ---- 4 ---------------------------------------------------------------------------------------------------------------------------


def test_split_keeps_components_together_and_proportions(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(300)]), f"t{rng.randrange(2000)}", rng.choice(["sms", "email"]), rng.choice(["legit", "spam"])) for i in range(3000)]
    out = group_split.grouped_split(spark.createDataFrame(rows, "msg_id bigint, `group` bigint, text string, domain string, label string"), ["group"]).toPandas()
    assert len(out) == 3000 and (out.groupby("component").split.nunique() == 1).all()
    group = {r[0]: r[1] for r in rows}
    out["group"] = out.id.map(group)
    assert (out.dropna(subset=["group"]).groupby("group").split.nunique() == 1).all()
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.06 and abs(share["val"] - 0.15) < 0.05


def test_split_closes_chains(spark):
    rows = [(1, 10, "a"), (2, 10, "b"), (3, 20, "b"), (4, 20, "c"), (5, 30, "d")]
    out = group_split.grouped_split(spark.createDataFrame(rows, "msg_id bigint, `group` bigint, text string"), ["group", "text"], strata=[])
    assert {r.id: r.component for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_leaking_groups(spark):
    rows = [(1, 1, "train"), (2, 1, " TEST "), (3, 2, "train"), (4, 2, "external"), (5, None, "val"), (6, 3, None), (7, 3, "Val")]
    out = group_split.leaking(spark.createDataFrame(rows, "msg_id bigint, `group` bigint, split string"))
    assert [r.group for r in out.collect()] == [1]


# ---- 5 ---------------------------------------------------------------------------------------------------------------------------

FINDER = personal.Finder({"Mara", "Zoé"}, {"Quillfeld", "Quillworth", "Quilldahl", "Bramfeld", "Bramworth", "Bramdahl", "Oskfeld", "Oskworth", "Oskdahl", "Salvworth", "Juniper"})


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail jo.bo+x@a-b.example.com now", [("email", "jo.bo+x@a-b.example.com")]),
        ("at jo [at] mail [dot] example [dot] com.", [("email", "jo [at] mail [dot] example [dot] com")]),
        ("call +44 7700 900 123 or (020) 7946-0123.", [("phone", "+44 7700 900 123"), ("phone", "(020) 7946-0123")]),
        ("text STOP to 60561, order no. 8802-7285-34", []),
        ("Confirm your SSN 979 45 7339 before", [("id_number", "979 45 7339")]),
        ("NI number QQ 13 66 78 B.", [("id_number", "QQ 13 66 78 B")]),
        ("passport Z5480824.", [("id_number", "Z5480824")]),
        ("return it to Flat 12, 141 Tansy St, Kelvane", [("address", "Flat 12, 141 Tansy St")]),
        ("at Tansystraße 185 today", [("address", "Tansystraße 185")]),
        ("Witness: Quillfeld, Mara, and Dr Zoé B. Oskfeld", [("name", "Quillfeld, Mara"), ("name", "Zoé B. Oskfeld")]),
        ("M. Bramdahl signed", [("name", "M. Bramdahl")]),
        ("Hello Mara, see you at Juniper Road", []),
        ("On July 24, 2018 14:13, Mara Quillfeld wrote:", [("name", "Mara Quillfeld")]),
        ("On 2018-07-24 14:13, Nils Bramfeld wrote:", [("name", "Nils Bramfeld")]),
        ("Mara Tolworth wrote:", [("name", "Mara Tolworth")]),
        ("Nils Tolworth said so near Tolworth", []),
        ("meet at 20A Osier Crescent", [("address", "20A Osier Crescent")]),
        ("soc sec no. 989 40 3686", [("id_number", "989 40 3686")]),
        ("mail mara [dot] q [at] post [dot] example now", [("email", "mara [dot] q [at] post [dot] example")]),
        ("ring 555-0142 tonight, code 555-0143 is for the door", [("phone", "555-0142")]),
        ("Mara moved; the 8 invoices on the road", []),
    ],
)
def test_personal_data(text, found):
    assert [(s.kind, text[s.start : s.end]) for s in FINDER.find(text)] == found


def test_personal_data_seen_through_lookalikes_and_masked():
    text = "Ring ０７７００９００１２３ or Маra Quill​feld."
    assert FINDER.replace(text) == "Ring [PHONE] or [NAME]."
    assert FINDER.replace("nothing here") == "nothing here"


@pytest.mark.parametrize(
    "validator, passes, fails",
    [
        ("tax_check", "86 095 742 719 it is", "86 095 742 718 it is"), ("mod97", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"), ("dni_check", "12345678Z here", "12345678A here"),
        ("ssn_rule", "a 123-45-6789 b", "a 923-45-6789 b"), ("nino_rule", "AB 12 34 56 C", "BG 12 34 56 C"), ("licence_rule", "MORGA657054SM9IJ", "MORGA637454SM9IJ"),
    ],
)
def test_a_validator_decides_where_no_word_does(monkeypatch, validator, passes, fails):
    assert [s.kind for s in FINDER.find(passes)] == ["id_number"] and FINDER.find(fails) == []
    monkeypatch.setattr(personal, validator, lambda value: False)
    assert FINDER.find(passes) == []


def test_a_long_list_of_names_finds_the_same(spark):
    listed = [("Mara", "given"), ("Zoé", "given"), (None, "given"), *((n, "surname") for n in FINDER.surnames)]
    names = spark.createDataFrame(listed, "name_text string, name_kind string")
    rows = [(1, "Mara Quillfeld wrote"), (1, "Zoé B. Oskfeld, Mara"), (2, None), (3, ""), (4, "call +44 7700 900 123"), (5, "Nils Tolworth wrote: Mara Tolworth"), (6, "nothing")]
    df = spark.createDataFrame(rows, "msg_id bigint, text string")
    found = [sorted(map(tuple, personal.personal_data(df, names, held=n).collect())) for n in (100, 3)]
    assert found[0] == found[1] and ("name", "Mara Tolworth") in {x[1:] for x in found[0]}
    masked = [sorted(map(str, personal.mask_personal_data(df, names, held=n).collect())) for n in (100, 3)]
    assert masked[0] == masked[1] and len(masked[0]) == len(rows)


def test_validators():
    assert personal.luhn("4539578763621486") and not personal.luhn("4539578763621487")
    assert personal.mod97("GB82WEST12345698765432") and not personal.mod97("GB82WEST12345698765433")
    assert personal.tax_check("86095742719") and not personal.tax_check("86095742710")


# ---- 6 ---------------------------------------------------------------------------------------------------------------------------


def test_copies(spark):
    rows = [
        (1, "sms", "Hello, World 1"), (2, "sms", "hello world1"), (3, "email", "hello world1"), (4, "sms", "Name: A; Cost: 5; Day: x"),
        (5, "sms", "Day = X\nName = a\nCost = 5"), (6, "sms", "name a cost 5 day x"), (7, "sms", "Name: A; Cost: 5"), (8, "sms", "Cost: 5; Name: A"), (9, "sms", "Hello, World 1"),
        (10, "email", "Plan: B; Sum: 7; Hour: y"), (11, "email", "Hour: y; Plan: B; Sum: 7"), (12, "sms", "plan b sum 7 hour y"), (13, "sms", "hour y plan b sum 7"),
    ]
    df = spark.createDataFrame(rows, "msg_id bigint, domain string, text string")
    got = {(r.id, r.keep_id) for r in copies.copy_members(df).collect()}
    assert got == {(1, 1), (2, 1), (9, 1), (3, 3), (4, 4), (5, 4), (6, 4), (7, 7), (8, 8), (10, 10), (11, 10), (12, 12), (13, 13)}
    assert {(r.keep_id, r.domain, r.copies) for r in copies.collapse_copies(df).collect()} == {(1, "sms", 3), (3, "email", 1), (4, "sms", 3), (7, "sms", 1), (8, "sms", 1), (10, "email", 2), (12, "sms", 1), (13, "sms", 1)}


# ---- 7 ---------------------------------------------------------------------------------------------------------------------------

SOUND = ["It’s £5 for “café” – naïve Grüße à la façon", "Ваш заказ задержан, оплатите до пятницы", "20m² ½ price, NÃO feche", "plain ascii", "¿Quién dejó?", "Ріck mе uр, Ні Іvо, Рiсе", "Það var góðæri í fyrra", "ærið ðæ"]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250"])
@pytest.mark.parametrize("layers", [1, 2])
def test_restore_round_trip(codec, layers):
    text = "It’s £5 for a café"
    bad = text
    for _ in range(layers):
        try:
            bad = bad.encode().decode(codec)
        except UnicodeDecodeError:
            pytest.skip("not every byte reads")
    assert encoding.restore(bad)[0] == text and encoding.is_garbled(bad)


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert encoding.restore(text) == (text, 0) and not encoding.is_garbled(text)


def test_cyrillic_read_as_latin_and_lost_characters():
    bad = SOUND[1].encode("cp1251").decode("cp1252")
    assert encoding.restore(bad)[0] == SOUND[1]
    assert encoding.is_garbled("caf�") and encoding.is_garbled("don\x92t")


@pytest.mark.parametrize("text", ["你好，世界", "안녕하세요", "สวัสดีครับ", "مرحبا بالعالم", "שלום עולם", "नमस्ते दुनिया", "こんにちは カタカナ", "a\u2003b\u3000c"])
def test_scripts_beyond_europe_are_restored(text):
    chars = encoding._single_bytes("cp1252")
    bad = "".join(chars[b] or chr(b) for b in text.encode())
    assert encoding.restore(bad)[0] == text and encoding.is_garbled(bad)
    assert encoding.restore(text) == (text, 0) and not encoding.is_garbled(text)


def test_one_cyrillic_word_read_as_latin():
    assert encoding.restore("Hello Привет".encode("cp1251").decode("cp1252"))[0] == "Hello Привет"
    assert encoding.restore("ÀÉÈ naïve") == ("ÀÉÈ naïve", 0)
    assert [encoding.restore(x)[0] for x in ("Âàø çàêàç", "Âàø êîä 4821", "Ïðèâåò ìèð")] == ["Ваш заказ", "Ваш код 4821", "Привет мир"]


def test_every_layer_is_undone():
    bad = "café"
    for _ in range(7):
        bad = bad.encode().decode("latin-1")
    assert encoding.restore(bad) == ("café", 7)


# ---- 1 ---------------------------------------------------------------------------------------------------------------------------

MAIL = """Subject: Re: plan
Hello Ivo,

The original message about the stew got lost, so we rename it.
From: the pier, turn left and ask for the vet.

> an answer
between
On 2012-04-06 07:32, Mara Quillfeld
wrote:
> old text

Kind regards
Nora

-- 
Nora Bramfeld
Vet, Weir tax Group
Tel: 020 7946 0102

Sent from my phone

P.S. more tomorrow.

-----Original Message-----
From: Mara <mara@x.test>
Sent: 2012-04-01 10:00
Subject: plan

Old body.

This e-mail and any files with it are meant for the intended
recipient only."""


def test_new_text_of_a_mail(spark):
    df = spark.createDataFrame([(1, MAIL, "s", None)], "msg_id bigint, text string, sender string, sent_at timestamp")
    old = {r.line_no for r in newtext.judged_lines(df).filter("not is_new").collect()}
    lines = MAIL.split("\n")
    new = [x for k, x in enumerate(lines, 1) if k not in old and x.strip()]
    assert new == ["Subject: Re: plan", "Hello Ivo,", *lines[3:5], "between", "Kind regards", "Nora", "P.S. more tomorrow."]


def test_recurring_closing_lines_of_a_sender(spark):
    block = "Weird Street Choir\nTuesdays in the hall"
    rows = [(k, f"Subject: s{k}\nBody number {k} is here today.\n\n{block}", "s", None) for k in (1, 2)] + [(3, f"Subject: s3\nOne more.\n\n{block}", "t", None)]
    df = spark.createDataFrame(rows, "msg_id bigint, text string, sender string, sent_at timestamp")
    old = {(r.id, r.line_no) for r in newtext.judged_lines(df).filter("not is_new").collect()}
    assert old == {(1, 4), (1, 5), (2, 4), (2, 5)}


def test_a_signature_above_a_long_quotation_is_evidence(spark):
    block, quoted = "Weird Street Choir\nTuesdays in the hall", "\n".join(f"> old line {k}" for k in range(20))
    rows = [(k, f"Subject: s{k}\nBody number {k} is here today.\n\n{block}\n\n{quoted}", "s", None) for k in (1, 2)]
    df = spark.createDataFrame(rows, "msg_id bigint, text string, sender string, sent_at timestamp")
    old = {(r.id, r.line_no) for r in newtext.judged_lines(df).filter("not is_new").collect()}
    assert {(1, 4), (1, 5), (2, 4), (2, 5)} <= old


def test_mails_with_a_common_opening_differ(spark):
    block, opening = "Weird Street Choir\nTuesdays in the hall", "We write to every member of the club once a week. " * 4
    rows = [(k, f"Subject: s\n{opening}\nBody number {k} is here today.\n\n{block}", "s", None) for k in (1, 2)]
    df = spark.createDataFrame(rows, "msg_id bigint, text string, sender string, sent_at timestamp")
    old = {(r.id, r.line_no) for r in newtext.judged_lines(df).filter("not is_new").collect()}
    assert old == {(1, 5), (1, 6), (2, 5), (2, 6)}


def test_an_unmarked_quotation_is_known_by_its_first_author(spark):
    from datetime import datetime

    first = "Subject: The plan\nHello Nora,\nThe pier opens at nine and closes late in the day.\nBring the red rope and both of the old lanterns."
    reply = "Subject: RE: the plan\nThe ropes are ready, the lanterns are not yet here.\n\nThe pier opens at nine and closes late in the day.\nBring the red rope and both of the old lanterns."
    day = lambda d: datetime(2020, 1, d)
    rows = [(1, first, "a", day(1)), (2, reply, "b", day(2)), (3, first, "c", day(3)), (4, reply, "a", day(4)), (5, reply, None, day(5)), (6, reply, "b", None)]
    df = spark.createDataFrame(rows, "msg_id bigint, text string, sender string, sent_at timestamp")
    old = lambda **how: {(r.id, r.line_no) for r in newtext.judged_lines(df, **how).filter("not is_new").collect()}
    assert old() == {(2, 4), (2, 5)}  # 3 is a copy, not a reply; 4 repeats what its sender wrote first
    assert old(ranks=False) == set()


# ---- 8 ---------------------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(8)
    sizes = [(i, rng.randint(0, 300)) for i in range(4000)]
    limits = [("small", 96), ("large", 1024)]
    out = packing.pack(spark.createDataFrame(sizes, "id bigint, tokens bigint").repartition(5), limits).toPandas()
    for name, capacity in limits:
        part = out[out.container == name]
        assert part.groupby("window").tokens.sum().max() <= capacity
        whole = part.sort_values("piece").groupby("id")
        assert whole.tokens.sum().to_dict() == dict(sizes)
        cut = whole.piece.count()
        assert all((cut[i] > 1) == (n > capacity) for i, n in sizes)
        assert (part.start == part.sort_values(["id", "piece"]).groupby("id").tokens.cumsum() - part.tokens).all()
        assert part.tokens.sum() / (part.window.nunique() * capacity) > (0.93 if name == "small" else 0.98)


# ---- 9 ---------------------------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randint(5, 40))) for i in range(40)]
    docs = []
    for i in range(120):
        body = sentence(rng, rng.randint(0, 200)).split()
        source = rng.choice(items)[1].split()
        n = rng.randint(9, 15)
        at = rng.randrange(max(1, len(source) - n))
        body[len(body) // 2 : len(body) // 2] = source[at : at + n]
        docs.append((i, ", ".join(body).upper()))
    grams = lambda t: {tuple(w[k : k + 12]) for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - 11)}
    want = {(d, i) for d, x in docs for i, y in items if grams(x) & grams(y)}
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "probe_id bigint, text string"))
    assert {(r.doc, r.item) for r in got.collect()} == want and want


# ---- 10 --------------------------------------------------------------------------------------------------------------------------

PROSE = [
    "On Saturday the caretaker wrote that the tent was southern and the spoon was not. They'll order it once the quay is dry.",
    "WIR KÖNNEN DAS PAKET ERST SPÄTER ABHOLEN, WEIL DER BUCHHALTER DAS FENSTER VERGESSEN HAT",
    "Ваш заказ задержан, оплатите до пятницы, и сосед просил передать ключи за свет",
    "lol the almond fell off the blanket again architect not happy can you bring it to me",
    "We met the vet at the mill and talked about the plan for the week ahead of us.\n- sealed ledger\n- rusty gate\nThen all of us went home by the old road.",
]
OTHER = [
    "1. tangled museum\n2. sunny cable\n3. heavy boiler\n4. urban potato",
    "| a | saddle | 2004-04-09 |\n| b | pepper | 2023-09-03 |\n| c | pillow | 2017-06-17 |",
    "lkvsfhdbhzxplf zhcgr\nqztdtnblljndth hkwxpdnpqdxfrdz",
    "yvfbqFy5361B9YrxnjUIqoc/GCylZZ2MMs+Xb6Kqk66TvUvonIAcfLGhDldw84qVmi+HWz2RBoJR",
    "free buy membership best handset streaming buy free crowded bundle damp ferry ringtone raffle",
    "2016-08-08 09:37:44 [ERR] meeting.review: code=302 q=0.9173\n2017-09-15 14:42:22 [INFO] carpet.calibrate: code=641 q=0.0972",
    ".plate { top: 35px; color: #712f53; }\n.stable { margin: 64px; color: #41e908; }",
    "meadow meadow meadow meadow meadow meadow meadow",
]


def test_prose_and_other_matter():
    assert [quality.profile(t)[-1] >= 0.5 for t in PROSE] == [True] * len(PROSE)
    assert [quality.profile(t)[-1] >= 0.5 for t in OTHER] == [False] * len(OTHER)


def test_statistics():
    stats = dict(zip([c.split()[0] for c in quality.COLUMNS], quality.profile("The cat sat.\nOn 2 mats!")))
    assert (stats["n_words"], stats["n_lines"], stats["end_punct_share"]) == (6, 2, 1.0)
    assert quality.divergence([1, 0, 0, 0, 0, 0, 0, 0], (1, 0, 0, 0, 0, 0, 0, 0)) == 0
