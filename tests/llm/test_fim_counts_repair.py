"""Fill-in-middle, token counts and conversation repair against brute-force versions, the library and awkward rows."""

import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from sparkveil.llm import op2_bpe, op11_fim, op12_token_counts, op13_repair

TEXTS = [
    None, "", "a", " ", "word", "two words", "x" * 9_001 + " y", " " * 4_100 + "ab" * 3_000, "é́é ǅ 𝒳𝒳 ﬁn​al\x00", "has <P> in it", "<S>", "tail <M>", "<", "<<P", "almost < P> <S <M", "line\r\nline\n\n", "A1b2C3" * 2_000, "日本語 text и текст",
]


def naive_fim(doc_id, text):
    text = text or ""
    units = re.findall("(?s)[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_against_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(None, "no id here"), (7, "again"), (7, "again")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, form string")
    done = op11_fim.transform(frame)
    from pyspark.sql import functions as F

    got = done.withColumn("back", op11_fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(d, *naive_fim(d, t), t or "") for d, t in docs]
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_offsets_of_pieces_are_those_of_the_whole():
    offsets, rng = op11_fim.Offsets(), random.Random(11)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Zz" * rng.randint(1, 3_000), " ", "é", "𝒳", "\n", "."]) for _ in range(rng.randint(0, 30)))
        assert list(offsets.ends(text)) == [m.end() for m in re.finditer("(?s)[A-Za-z]+|[^A-Za-z]", text)]


def test_token_counts_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op2_bpe.tokenizer_path())
    rng = random.Random(12)
    bits = ["hello", "HELLO", "isn't", "'s", "’s", "é", "é", "Å", "Å", "İ", "ß", "ſ", "ﬁ", "日本", "안녕", "ก็", "😀", "👩‍👩‍👧", "123", "½", "<|endoftext|>", "<|startoftext|>", "<|endoftext|", " ", "  ", "\t", "\n", " ", " ", "​", "_", "--", "a" * 400, "ab" * 300, "\x00", "\x1c", "\x85", ".", "don'T", "'LL"]
    texts = [*TEXTS, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(1_500)), "the cat sat " * 2_000, "z" * 60_000]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in op12_token_counts.count_tokens(rows).collect()}
    assert [got[k].n_tokens for k in range(len(texts))] == want
    assert all(got[k].n_bytes == len((t or "").encode()) and got[k].over_limit == (want[k] > 2048) for k, t in enumerate(texts))


def test_token_counter_forgets_and_windows(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op12_token_counts, "KEPT", 50)
    monkeypatch.setattr(op12_token_counts, "WINDOW", 64)
    library, counter, rng = Tokenizer.from_file(op2_bpe.tokenizer_path()), op12_token_counts.Counter(op2_bpe.tokenizer_path()), random.Random(3)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdeé'.1") for _ in range(rng.randint(1, 90))) for _ in range(60))
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counter.words) <= 50 + 64


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="drops white space"):
        op12_token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))


def damage(rows):
    """The contract's damage of (conv_id, turn, role, text) rows, in their defined order."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, delete=2, insert=5):
    """Best repair from the last row backwards: (cost, audit, lines)."""
    sys.setrecursionlimit(20_000)
    kinds, memo = faults(rows), {}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def best(k, state, inserts):
        if (k, state, inserts) in memo:
            return memo[k, state, inserts]
        options = [(0, "", [])] if k == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, rest):
            if rest:
                options.append((cost + rest[0], letter + rest[1], ([line] if line is not None else []) + rest[2]))

        if inserts < 2:
            for c, to in after[state].items():
                if c in names:
                    add(insert, "I", names[c] + ":", best(k, to, inserts + 1))
        if k < len(rows):
            _, role, text = rows[k]
            add(delete, "D", None, best(k + 1, state, 0))
            if kinds[k] in ("", "truncated"):
                more = 5 * (kinds[k] == "truncated")
                for c, to in after[state].items():
                    if role[:1] == c:
                        add(more, "K", f"{role}:{text}", best(k + 1, to, 0))
                    if c in names:
                        add(1 + more, "R", f"{names[c]}:{text}", best(k + 1, to, 0))
        memo[k, state, inserts] = min(options, default=None, key=lambda o: o[:2])
        return memo[k, state, inserts]

    return best(0, "", 0)


def enumerated(rows, delete=2, insert=5):
    """Every edit of few rows, judged by the grammar's regular expression."""
    kinds, found = faults(rows), []
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for (_, role, _), kind in zip(rows, kinds, strict=True):
        more = 5 * (kind == "truncated")
        choices.append([(delete, "D", "")] + ([] if kind in ("blank", "duplicate") else [(more, "K", role[:1] or "-"), (1 + more, "R", "u"), (1 + more, "R", "a")]))
    for own in itertools.product(*choices):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            initials = between[0] + "".join(o[2] + g for o, g in zip(own, between[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", initials):
                cost = sum(o[0] for o in own) + insert * sum(map(len, between))
                found.append((cost, "I" * len(between[0]) + "".join(o[1] + "I" * len(g) for o, g in zip(own, between[1:], strict=True))))
    return min(found)


def expected(conv, source):
    rows = damage(source)
    cost, audit, lines = cheapest(rows)
    kinds, turns = faults(rows), {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, longest):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "cut off", "", " \t\x0b", "Why?", "Tell me more. ", " ", None]
    roles = ["user", "user", "assistant", "assistant", "system", "", None, "tool", "User", "ux"]
    out = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, longest)):
            row = (conv, rng.choice([None, *range(longest + 4)]), rng.choice(roles), rng.choice(said))
            out += [row] * rng.choice([1, 1, 1, 2])
    return out


def answers(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    return sorted(map(repr, (tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got)))


def test_repair_against_brute_force(spark, tmp_path):
    rows = conversations(13, 150, 9)
    want = [expected(c, [r for r in rows if r[0] == c]) for c in dict.fromkeys(r[0] for r in rows)]
    assert answers(spark, tmp_path, rows) == sorted(map(repr, want))
    assert any("D" in w[7] for w in want) and any("R" in w[7] for w in want)


@pytest.mark.parametrize(("delete", "insert"), [(2, 5), (4, 1), (1, 1)])
def test_cheapest_repair_is_that_of_all_edits(monkeypatch, delete, insert):
    """At the contract's costs an insert never pays; at others it does, and the forward pass finds the same edits."""
    monkeypatch.setattr(op13_repair, "DELETE", delete)
    monkeypatch.setattr(op13_repair, "INSERT", insert)
    codes = {"blank": op13_repair.BLANK, "duplicate": op13_repair.DUPLICATE, "truncated": op13_repair.CUT, "": op13_repair.FINE}
    rows, used = conversations(5, 60, 2), ""
    for c in dict.fromkeys(r[0] for r in rows):
        own = damage([r for r in rows if r[0] == c])[:3]
        layer = op13_repair._close({op13_repair.NOTHING: (0, "")})
        for (_, role, _), kind in zip(own, faults(own), strict=True):
            layer = op13_repair._advance(layer, role[:1], codes[kind])
        found = min(layer[s] for s in op13_repair.FINAL if s in layer)
        assert cheapest(own, delete, insert)[:2] == enumerated(own, delete, insert) == found, own
        used += found[1]
    assert ("I" in used) == (insert < delete)


def test_a_conversation_over_many_segments(spark, monkeypatch):
    """One conversation holds most rows: cut over tasks and segments of seven rows, same edits."""
    rows = [r[1:] for r in conversations(29, 40, 9)]
    long = [(1, k * 3 if k % 5 else None, r[1], r[2]) for k, r in enumerate(rows)] + [(1, 700 + k, "user", "And?") for k in range(60)] + [(1, 800 + k, "us"[k % 2 :] and ("user", "assistant")[k % 2], f"So {k}.") for k in range(100)]
    short = [(2, 0, "assistant", "Hi."), (2, 1, "user", "Hi!"), (3, 5, "system", "Be kind.")]
    whole = {c: sorted(((t, " " if r is None else r, " " if x is None else x) for k, t, r, x in [*long, *short] if k == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for c in (1, 2, 3)}
    frame = spark.createDataFrame([*long, *short], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, found = op13_repair.repair(frame, most=7)
        lines = {r.conv_id: r for r in op13_repair.written(turns).collect()}
        costs = {r.conv_id: r for r in found.collect()}
        said = turns.where("conv_id = 3").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for c, own in whole.items():
        cost, audit, text = cheapest(own)
        kinds = faults(own)
        assert (costs[c].cost, lines[c].audit, lines[c].repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()), c
        assert (costs[c].blank, costs[c].duplicate, costs[c].truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert costs[c].illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        known = {t for t, _, _ in own if t is not None}
        assert costs[c].gaps == max(known) - min(known) + 1 - len(known)
    assert [(r.audit, r.said) for r in said] == [("D", [])]


def test_dropped_conversations_stay(spark, tmp_path):
    gone = next(k for k in range(1_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert answers(spark, tmp_path, [(gone, 0, "user", "Hi.")]) == [repr((gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))]
