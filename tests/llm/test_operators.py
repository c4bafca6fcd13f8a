"""The corpus operators against brute force on awkward rows, and on the small tables."""

import hashlib
import re
import time
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm import chat, common, decontaminate, language, mixing, pii, queries, ranking, repeats, rules, similar, simple8b, tokens
from orbweave.llm.components import components
from tests.llm.conftest import held_out, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def key(x):
    return sorted(x, key=str)


# ---- mixing ----------------------------------------------------------------------------------------------------------


def fair_targets(sizes, weights=(3, 1, 2)):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > 2 * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix(docs, awkward):
    found = [tuple(r) for r in mixing.mix(docs, block_words=4, shard_docs=4).collect()]
    again = [tuple(r) for r in mixing.mix(docs.repartition(5), block_words=4, shard_docs=4).collect()]
    assert key(found) == key(again) and len(found) == len(awkward)
    sizes = Counter()
    for _, t, _, s in awkward:
        sizes[s] += len(WORD.findall(t or ""))
    goal = fair_targets(sizes)
    assert key((i, s, n) for i, s, n, *_ in found) == key((i, s, len(WORD.findall(t or ""))) for i, t, _, s in awkward)
    took = Counter()
    for _, s, n, whole, target, taken, _ in found:
        assert whole == sizes[s] and target == pytest.approx(goal[s]) and 0 <= taken <= 2 * n
        took[s] += taken
    for s, target in goal.items():
        assert abs(took[s] - target) <= 8 + 4 * (sizes[s] > 0)


def test_hot_ids_spread_over_shards(spark):
    """Half of the rows without an id and of one size: what is taken of them is close to their share, and no shard holds them all."""
    rows = [(None, prose(i, 5), "a") for i in range(2000)] + [(i, prose(5000 + i, 5), "a") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df, share=0.6, block_words=4, shard_docs=100).toPandas()
    shards = found.assign(shard=[int(hashlib.md5(f"18:{'' if i != i else int(i)}:{n}:{m}".encode()).hexdigest()[:15], 16) % 40 for i, n, m in zip(found.doc_id, found["size"], found["mark"], strict=True)])
    assert shards.groupby("shard").size().max() < 200
    assert abs(found.taken.sum() - 0.6 * 20_000) <= 8


def test_mix_whole_table(spark):
    found = queries.op1_mixing(spark, SF).toPandas()
    assert len(found) == 200 and (found.taken <= 2 * found["size"]).all()
    by = found.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(by.taken - by.target) <= 0.02 * by.target).all()


def test_mixed_texts(docs, awkward, none):
    made = mixing.mixed_texts(docs, block_words=4, shard_docs=4)
    assert made.columns == docs.columns
    took = Counter()
    for r in mixing.mix(docs, block_words=4, shard_docs=4).collect():
        took[r.doc_id] += r.taken
    words = Counter()
    texts = {}
    for i, t, *_ in awkward:
        texts.setdefault(i, []).append(t)
    for r in made.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in texts[r.doc_id] or any(WORD.findall(t)[: len(r.text.split(" "))] == r.text.split(" ") for t in texts[r.doc_id])
    assert words == took
    assert mixing.mix(none).count() == 0 and mixing.mixed_texts(none).count() == 0


def test_mixed_texts_of_equal_rows(spark):
    """Rows of one id and source, equal or of equal size: every word that is taken is there, of none more than twice its own."""
    rows = [(i % 3 if i % 3 else None, prose(i % 5, 7), "ab"[i % 2]) for i in range(120)] + [(5, "one two three", "a")] * 31
    df = spark.createDataFrame([(*x, {"k": 1}) for x in rows], "doc_id long, text string, source string, m map<string,int>").repartition(3)
    took = Counter()
    for r in mixing.mix(df, block_words=4, shard_docs=16).collect():
        took[r.doc_id, r.source] += r.taken
    made = mixing.mixed_texts(df, block_words=4, shard_docs=16).collect()
    words = Counter()
    for r in made:
        words[r.doc_id, r.source] += len(r.text.split())
    assert words == took and all(r.m == {"k": 1} for r in made)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=7), st.integers(0, 60))
def test_seats_are_highest_quotients(spark, claims, total):
    df = spark.createDataFrame([(f"k{i}", float(c), total, 0) for i, c in enumerate(claims)], "k string, c double, n long, g int").coalesce(1)
    found = {r.k: r.quota for r in mixing.seats(df, "k", "c", "n", ["g"]).collect()}
    quotients = sorted(((-c / (2 * j + 1), f"k{i}") for i, c in enumerate(claims) if c > 0 for j in range(total + 1)))
    expected = Counter(k for _, k in quotients[:total])
    assert {k: v for k, v in found.items() if v} == dict(expected)


# ---- personal data -----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                ok = 14 <= len(digits) <= 19 and total % 10 == 0
            if kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1 29.@+-()_%\n4é", max_size=60))
def test_patterns_match_plain_regular_expressions(text):
    assert pii.patterns(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8)), max_size=12), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8)), max_size=12))
def test_overlaps(a, b):
    spans, taken = ([(x, x + n, "phone") for x, n in s] for s in (a, b))
    assert pii.apart_from(spans, taken) == [s for s in spans if not any(s[0] < t[1] and t[0] < s[1] for t in taken)]


def test_many_spans_are_linear():
    import time

    field = pii.Field().fit(pii.table())
    text = "\n".join(f"bob{i}@example{i}.com wrote, call (743) 555-{i:04d} now" for i in range(8000))
    took = [0.0, 0.0]
    for k, part in enumerate((text[: len(text) // 4], text)):
        started = time.perf_counter()
        base, every, _ = pii.all_spans([part], field)[0]
        took[k] = time.perf_counter() - started
    assert len(base) == 8000 and len(every) >= len(base) and took[1] < 8 * took[0] + 1


def test_patterns_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "@" * 200_000, "1 " * 100_000):
        pii.patterns(text)
        list(pii.odd_words(text))


def test_pii(docs, awkward, none):
    found = {(r.doc_id, r.n_email): r for r in pii.personal_data(docs).collect()}
    assert pii.personal_data(docs).count() == len(awkward) and pii.personal_data(none).count() == 0
    for i, t, _, _ in awkward:
        base = plain_spans(t or "")
        r = found[i, sum(s[2] == "email" for s in base)]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, b, k in base))
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r.spans.split(","))
    r = found[16, 1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)


def drawn(n, seed):
    """Word sequences with their labels, drawn from rules that know nothing of the field's table."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    name = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(3, 10))))
    dom = lambda: name() + "." + pick(["com", "org", "net", "example.com", "de", "co.uk", "fr"])

    def item(kind: str) -> list[str]:
        if kind == "email":
            return [pick([f"{name()}@{dom()}", f"{name()}.{name()}@{dom()}", f"{name()}{digits(2)}@{dom()}", f"{name()}+{name()}@{dom()}"])]
        if kind == "ip":
            return [".".join(str(int(x)) for x in rng.integers(0, 256, 4))]
        if kind == "card":
            cut = pick([[4, 4, 4, 4], [4, 6, 5]])
            said = digits(sum(cut) - 1)
            said += next(x for x in "0123456789" if pii.luhn(said + x))
            parts = [said[sum(cut[:i]) : sum(cut[: i + 1])] for i in range(len(cut))]
            return pick([parts, [said], ["-".join(parts)]])
        a, b, c = digits(3), digits(3), digits(4)
        return pick([[f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"+{digits(2)}", a, b, c], [f"+{digits(1)}-{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{digits(11)}"]])

    def other() -> str:
        return pick([digits(1), digits(2), digits(3), digits(4), digits(5), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(1)},{digits(3)}", f"{name()}{digits(2)}", f"@{name()}", f"{digits(2)}%", f"${digits(3)}", "+", f"{name()}+{name()}", f"#{digits(4)}", f"v{digits(1)}.{digits(2)}", f"{digits(12)}", f"{name()}={digits(20)}", f"{name()}_{digits(16)}", f"{digits(8)}{name()}{digits(8)}"])

    out = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(int(rng.integers(2, 5))):
            filler = [name() for _ in range(int(rng.integers(1, 4)))]
            if rng.random() < 0.2:
                filler.append(pick("mail call phone tel host card visa address token".split()))
            words += filler
            labels += ["O"] * len(filler)
            kind = pick([*PLAIN, "O", "O"])
            got = [other()] if kind == "O" else item(kind)
            if rng.random() < 0.3:
                got[-1] += pick([".", ",", ";"])
            words += got
            labels += [kind] * len(got)
        words.append(name())
        labels.append("O")
        out.append((words, labels))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.Field().fit(pii.table())


def test_labelled_table():
    rows = pii.table()
    assert len(rows) > 90 and all(len(w) == len(y) for w, y in rows) and {x for _, y in rows for x in y} == set(pii.LABELS)
    assert (["(see", "x@y.net)"], ["O", "email"]) in rows


def test_field_on_sequences_of_another_origin(field):
    """Recall of the words of each kind, and how many other words are taken for one."""
    hit, seen, wrong, free = Counter(), Counter(), 0, 0
    for words, labels in drawn(400, 99):
        path = field.viterbi([field.scores(words, field.ids(words))])[0]
        for p, y in zip(path, labels, strict=True):
            hit[y] += pii.LABELS[p] == y
            seen[y] += 1
            wrong += y == "O" and pii.LABELS[p] not in ("O", "secret")
            free += y == "O"
    print({y: round(hit[y] / seen[y], 3) for y in seen}, wrong / free)
    assert all(hit[y] / seen[y] > 0.8 for y in seen) and wrong / free < 0.02


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["see", "(743)", "555-3824", "12", "things", "4111.1111", "a@b.com,", "10.0.0.1", "token", "=", '"f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', "+", "\n", "x" * 100, "1a" * 90, "  ", "call", "+1", "(at)", "(dot)", "[AT].", "firm.org", "a(at)b(dot)c"]), max_size=25))
def test_runs_decode_as_the_whole_text(field, words):
    text = " ".join(words)
    spans = [m.span() for m in WORD.finditer(text)]
    said = [text[a:b] for a, b in spans]
    path = field.viterbi([field.scores(said, field.ids(said))])[0] if said else []
    assert pii.field_spans([text], field) == [list(pii.labelled_spans(text, spans, path))]


def test_added_spans_on_documents(field):
    """Secrets and numbers of the small documents: all secrets are found, and nothing in documents without digits or @."""
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    rows = pii.all_spans(texts, field)
    there = [m.span(1) for t in texts for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
    found = [(a, b) for *_, s in rows for a, b, _ in s]
    assert there and Counter(found) == Counter(there)
    added = [text[a:b] for text, (base, every, _) in zip(texts, rows, strict=True) for a, b, k in every if (a, b, k) not in base]
    assert len(added) <= 0.02 * sum(len(base) for base, *_ in rows), added
    # documents' phone numbers are found without their +, which no pattern takes
    cut = [t.replace("+1 (", "(") for t in texts if re.search(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", t)]
    got = [sum(k == "phone" for *_, k in every) for _, every, _ in pii.all_spans(cut, field)]
    assert cut and sum(map(bool, got)) >= 0.9 * len(cut)


def test_spelled_out_addresses_in_documents(field):
    """Addresses without @ placed in real documents are found whole, as spans that no pattern gives; bracketed words elsewhere aren't."""
    rng = np.random.default_rng(5)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) > 200 ORDER BY doc_id LIMIT 400").fetchall()]
    name = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuvw"), int(rng.integers(3, 9))))
    cases, clean = [], []
    for text in texts:
        ends = [m.end() for m in re.finditer(r"(?<=[a-z])(?= [a-z])", text)]
        if not ends:
            continue
        at = int(ends[rng.integers(len(ends))])
        left, right = ["()", "[]", "{}", "<>"][rng.integers(4)]
        gap = " " if rng.random() < 0.8 else ""
        local = name() + rng.choice(["", "." + name(), str(rng.integers(10, 99)), "_" + name()])
        dot = f"{gap}{left}dot{right}{gap}" if rng.random() < 0.7 else "."
        address = f"{local}{gap}{left}{rng.choice(['at', 'AT'])}{right}{gap}{name()}{dot}{rng.choice(['org', 'com', 'net', 'de', 'info'])}"
        cases.append((text[:at] + " " + address + text[at:], at + 1, at + 1 + len(address)))
        clean.append(text[:at] + f" {rng.choice(['(at)', '(dot)', '[at]', '(point)'])}" + text[at:])
    found = pii.all_spans([t for t, *_ in cases], field)
    hits = sum((a, b, "email") in every and (a, b, "email") not in base for (_, a, b), (base, every, _) in zip(cases, found, strict=True))
    wrong = sum(any(k == "email" and (a, b, k) not in base for a, b, k in every) for base, every, _ in pii.all_spans(clean, field))
    print(hits / len(cases), wrong / len(clean))
    assert len(cases) > 300 and hits >= 0.9 * len(cases) and wrong <= 0.01 * len(clean)


def test_spelled_out_marks_are_linear(field):
    """Very many marks, in one word and as words, with long blanks between."""
    for text in ("a(at)" * 100_000, "a (at) " * 20_000, ("a (dot)" + " " * 2000) * 500, "(at)" * 100_000 + "." * 100_000):
        started = time.perf_counter()
        pii.all_spans([text], field)
        assert time.perf_counter() - started < 20


def test_viterbi_is_best_path():
    rng = np.random.default_rng(0)
    field = pii.Field()
    field.move = rng.standard_normal((6, 6))
    from itertools import product

    for n in (1, 2, 3, 5):
        e = rng.standard_normal((n, 6))
        score = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))
        assert tuple(field.viterbi([e, e[:1]])[0]) == max(product(range(6), repeat=n), key=score)


# ---- chat ------------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "a<b[c]\\d\\l</s>"), (1, 1, "assistant", "</s>[INST] ok \\\\l[/INST]"), (2, 0, "assistant", "x"), (3, 0, "user", None), (3, None, None, "z"), (3, 0, "user", None), (None, 0, "sys[tem", "é\U0001f600"), (4, 0, "system", ""), (4, 1, "user", "q"), (4, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, valid int, formatted string")
    made = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    found = {r.conv_id: r for r in made.collect()}
    for i, r in found.items():
        mine = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == i))
        assert [(t.role, t.text) for t in r.back] == [(x[2], x[3]) for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted and r.formatted.count("</s>") == len(mine)
    assert found[1].valid and found[4].valid and not found[2].valid and found[2].bad_turn == 0 and not found[3].valid
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- quality ---------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines, earlier, dups = text.split("\n"), set(), 0
    for line in lines:
        dups += bool(WORD.search(line)) and line in earlier
        earlier.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered), failed


def test_rules(docs, awkward, none):
    found = rules.judged(docs, min_docs=2).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert key((r.doc_id, *[r[c] for c in columns]) for r in found) == key((i, *brute_counts(t or "")) for i, t, _, _ in awkward)
    assert not any(r.kept and r.base_failed for r in found)
    assert rules.judged(none).count() == 0


def brute_kept(rows, min_docs):
    """The verdicts by plain loops over characters and words."""
    marks, symbols = ".,;:!?'\"()-", "#*$%&|<>"

    kinds = [string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t\n\r\x0b\x0c", marks, symbols]

    def classes(text):
        out = [0] * 8
        for c in text:
            out[next((i for i, kind in enumerate(kinds) if c in kind), 6 if ord(c) > 127 else 7)] += 1
        return out

    def bare(word):
        for _ in range(2):
            word = word[1:] if len(word.encode()) > 1 and word[0] in marks else word
            word = word[:-1] if len(word.encode()) > 1 and word[-1] in marks else word
        return lower(word)

    texts = [(t or "", [bare(w) for w in WORD.findall(t or "")], brute_counts(t or "")[-1]) for _, t, *_ in rows]
    found = [[sum(w in words for w in said) for words in rules.COMMON.values()] for _, said, _ in texts]
    histogram = lambda said, words: [said.count(w) for w in words] + [max(0, len(said) - sum(w in words for w in said))]
    speaks = lambda n, said: n >= max(1, 0.12 * len(said))
    references = []
    for i, words in enumerate(rules.COMMON.values()):
        mine = [x for x, n in zip(texts, found, strict=True) if not x[2] and n.index(max(n)) == i and speaks(n[i], x[1])]
        if len(mine) >= min_docs:
            sums = [[sum(x) for x in zip(*rs, strict=True)] for rs in ([classes(t) for t, *_ in mine], [histogram(s, words) for _, s, _ in mine])]
            references.append((i, words, *[[v / sum(x) for v in x] for x in sums]))

    def apart(n, q):
        p = [v / sum(n) for v in n]
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return np.sqrt(max(0, (kl(p) + kl(q)) / 2))

    for (text, said, failed), hits in zip(texts, found, strict=True):
        n, far = classes(text), False
        mine = [r for r in references if speaks(hits[r[0]], said)]
        short = 1 / np.sqrt(max(1, len(said)))
        if len(said) >= 50 and mine:
            far = min(apart(n, c) for *_, c, _ in mine) > 0.18 + 0.6 * short
            far |= min(apart(histogram(said, words), q) for _, words, _, q in mine) > 0.25 + 0.7 * short
        elif len(said) >= 50 and not any(speaks(h, said) for h in hits) and n[6] / max(1, sum(n) - n[3]) <= 0.5:
            far = apart([n[0] + n[1] + n[6], *n[2:6], n[7]], [0.81, 0.002, 0.164, 0.024, 0, 0]) > 0.18 + 0.6 * short
        yield not failed and not far


def test_verdicts_by_plain_loops(spark, awkward):
    texts = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE doc_id < 90 AND length(text) < 4000").fetchall()
    rows = [(i, t) for i, t, *_ in awkward if len(t or "") < 4000] + [(1000 + i, t) for i, t in texts]
    rows += [(2000 + i, " ".join("日本語テキスト文書品質"[(i + j) % 9 :][:3] + str(j) for j in range(70))) for i in range(5)]
    found = rules.judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_docs=3).collect()
    expected = list(zip((i for i, _ in rows), brute_kept(rows, 3), strict=True))
    assert key((r.doc_id, r.kept) for r in found) == key(expected)
    assert all(kept for i, kept in expected if (i or 0) >= 2000) and {kept for i, kept in expected if 1000 <= (i or 0) < 2000} == {True, False}


#: Frequent words and others of two languages without a word list.
FOREIGN = {
    "it": ("di che il per non sono gli della anche dei questo alla nel più come delle ha ma", "casa tempo anno giorno persona lavoro parte città storia mondo strada libro scuola acqua famiglia governo mare luce"),
    "pl": ("nie się na jest do że jak ale po co tak za od przez był tylko już czy", "dom czas rok dzień człowiek praca część miasto historia świat droga książka szkoła woda rodzina światło góra rząd"),
}


def foreign(language, i):
    import random

    r = random.Random(f"{language}{i}")
    often, rest = (w.split() for w in (FOREIGN[language] if language in FOREIGN else ("the of and to in a is that for it as was with be by", "house time year day person work part city history world road book school water family light")))
    return " ".join(r.choice(often) if r.random() < 0.4 else r.choice(rest) + r.choice(["", "", "", ",", "."]) for _ in range(200))


def test_verdicts_do_not_depend_on_other_languages(spark):
    """Texts in languages without a list, few or many of them, beside few or many English ones: the same verdicts each time."""
    verdicts = []
    for n, m in ((400, 10), (100, 100), (0, 10), (30, 400)):
        rows = [(f"{x}{i}", foreign(x, i)) for x, k in (("en", n), ("it", m), ("pl", m)) for i in range(k)]
        names = {j: name for j, (name, _) in enumerate(rows)}
        table = spark.createDataFrame([(j, t) for j, (_, t) in enumerate(rows)], "doc_id long, text string")
        verdicts.append({names[r.doc_id]: (r.kept, r.base_failed) for r in rules.judged(table).collect()})
    for a in verdicts:
        for b in verdicts:
            assert all(a[k] == b[k] for k in a.keys() & b.keys())
        assert all(kept for name, (kept, failed) in a.items() if not failed) and not all(failed for _, failed in a.values())


def test_distance():
    from math import log2, sqrt

    p, q = [3, 1, 0], [0.2, 0.3, 0.5]
    found = rules.distances(np.array([p, [0, 0, 0]]), np.array(q))
    ps = [x / 4 for x in p]
    m = [(a + b) / 2 for a, b in zip(ps, q, strict=True)]
    kl = lambda a: sum(x * log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert found[0] == pytest.approx(sqrt((kl(ps) + kl(q)) / 2)) and np.isnan(found[1])


@pytest.fixture(scope="module")
def labels():
    return duckdb.sql("SELECT * FROM '/root/testdata/sf0.01/labels.parquet'").df().set_index("doc_id")


def test_rules_keep_clean(spark, labels):
    found = queries.op5_rules(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").join(labels, how="inner")
    found = found[[held_out(i) for i in found.index]]  # the fold that no limit was chosen on
    good = found[(found.quality == 1) & ~found.base_failed]
    assert good.kept.mean() > 0.98 and found[found.quality == 0].kept.mean() < 0.1


def test_quality_held_out(spark, labels):
    found = queries.op4_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    assert (found.held_out == [held_out(i) for i in found.index]).all() and found.score.between(0, 1).all()
    assert ((found.score >= 0.5) == (found.predicted == 1)).all()
    both = found[found.held_out].join(labels, how="inner")
    assert (both.predicted == both.quality).mean() > 0.95


def test_reruns_agree(spark):
    """Scores and predictions don't depend on how the tables are dealt out; some ids repeat."""
    table = lambda name: queries.table(spark, "/root/testdata/sf0.01", name)
    docs, labels = table("documents").filter("length(text) < 3000"), table("labels")
    docs = docs.union(docs.filter("doc_id % 7 = 0").withColumn("text", F.upper("text")))
    for f in (lambda d, m: ranking.scored(d, m, sample=60), lambda d, m: language.identified(d, 200)):
        one, two = f(docs.coalesce(1), labels), f(docs.repartition(6, "text"), labels.repartition(5))
        assert key(map(tuple, one.collect())) == key(map(tuple, two.collect()))


def test_quality_edges(spark, docs, awkward, none):
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (8, 0, 0), (8, 0, 0), (None, 1, 0), (3, None, 0), (4, 1, 0), (12, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    found = ranking.scored(docs, marks).collect()
    assert len(found) == len(awkward) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in ranking.scored(docs, marks.limit(0)).collect()} == {0.5}
    assert ranking.scored(none, marks).count() == 0


def test_quality_learns_from_every_label(spark):
    """Bad labels that lie beyond the 20,000 labels with the smallest hashes are learned as well."""
    ids = spark.range(60_000).select(F.col("id").alias("doc_id"), common.held_out(F.col("id")).alias("out")).orderBy("out", F.xxhash64("doc_id")).toPandas()
    ids["good"] = np.where(ids.out, ids.doc_id % 2, ids.index < 20_000).astype(int)
    ids["text"] = np.where(ids.good == 1, "the house of the sea and the road to a town", "$$$$ #### !!!! 1234 $$$$ ####")
    rows = spark.createDataFrame(ids[["doc_id", "text", "good"]])
    labels = rows.select("doc_id", F.col("good").alias("quality"), F.lit(0).alias("toxic"))
    found = ranking.scored(rows, labels).toPandas().merge(ids, on="doc_id")
    assert found.held_out.sum() > 10_000 and (found.predicted == found.good).all()


def test_fit_of_all_pairs(spark):
    """Weights are those of the likelihood of every good row against every bad one; quantiles are exact, weights of rows counted."""
    r = np.random.default_rng(4)
    k, n = len(ranking.FEATURES), 400
    x = r.normal(size=(n, k)) * r.uniform(0.1, 3, k)
    good = (x[:, 0] + x[:, 1] / 2 + r.normal(size=n) > 0.5).astype(int)
    times = r.integers(1, 4, n)
    rows = common.stored(spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, good, times, strict=True)], "x array<double>, good int, weight long").repartition(3), "test-fit")
    whole, mark = np.repeat(x, times, 0), np.repeat(good, times)
    z = (whole - whole.mean(0)) / whole.std(0)
    d = (z[mark == 1][:, None] - z[mark == 0]).reshape(-1, k)
    w = np.zeros(k)
    for _ in range(20):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(k), d.T @ p / len(d) - 1e-3 * w)
    assert np.allclose(ranking.fit(rows) * whole.std(0), w, atol=2e-3 * np.abs(w).max())
    assert ranking.fit(rows.filter("good = 1")) is None


@pytest.mark.parametrize("collected", [5, 10_000])
def test_order_statistics(spark, monkeypatch, collected):
    monkeypatch.setattr(ranking, "COLLECTED", collected)
    r = np.random.default_rng(5)
    v, times = np.r_[r.normal(size=300).round(1), r.normal(size=200), 1e6, 1e-9], r.integers(1, 4, 502)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, times, strict=True)], "v double, weight long").persist()
    whole = np.sort(np.repeat(v, times))
    ranks = [0, 1, 17, 500, len(whole) // 2, len(whole) - 1]
    assert ranking.order_statistics(rows, ranks) == whole[ranks].tolist()
    assert ranking.quantile(rows, len(whole), 0.3) == pytest.approx(np.quantile(whole, 0.3), abs=1e-12)


# ---- similarity and repeats ----------------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(x), find(i)) for i, x in sets]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_similar(spark, docs, awkward, none, k, percent):
    found = similar.linked_documents(docs, k, percent, 1.0).collect()
    assert key(map(tuple, found)) == key(brute_components(awkward, k, percent))
    assert similar.linked_documents(none).count() == 0


def test_similar_chains_and_groups(spark):
    """A chain of drifting copies, a large group of near copies and one of equal texts, around the threshold."""
    import random

    r = random.Random(5)
    rows, words = [], prose(11, 150).split()
    for i in range(25):
        rows.append((100 + i, " ".join(words)))
        words[r.randrange(150)] = f"w{i}"
    base = prose(12, 120).split()
    for i in range(60):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(120)] = f"v{r.randrange(40)}"
        rows.append((300 + i, " ".join(own)))
    rows += [(500 + i, " ".join(base).upper()) for i in range(20)]
    r.shuffle(rows)
    for k, percent in ((3, 90), (5, 80)):
        found = similar.linked_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k, percent, 0.5)
        assert key(map(tuple, found.collect())) == key(brute_components(rows, k, percent))


@pytest.mark.parametrize(("k", "percent", "extra"), [(3, 90, 1.0), (5, 80, 0.5)])
def test_similar_contained_sets(spark, k, percent, extra):
    """Texts and their beginnings, all pairs of small sizes that link, no third text alike."""
    rows = []
    for n in range(1, 61):
        for b in range(-(-percent * n // 100), n):
            words = [f"n{n}b{b}w{i}" for i in range(n + k - 1)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: b + k - 1]))]
    found = similar.linked_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k, percent, extra)
    assert key(map(tuple, found.collect())) == key((i, len(t.split()) - k + 1, i - i % 2) for i, t in rows)


def test_similar_one_id_for_two_classes(spark):
    """Rows of one id with different texts of one size, and a copy and a near copy of each."""
    one, two = prose(21, 150).split(), prose(22, 150).split()
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one)), (3, " ".join(two))]
    rows += [(4, " ".join(one[:-1] + ["x"])), (5, " ".join(two[:-1] + ["y"])), (6, prose(23, 150))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = similar.linked_documents(frame, 3, 90, 1.0).collect()
    assert key(map(tuple, found)) == key(brute_components(rows, 3, 90))
    assert {r.component_id for r in found if r.doc_id < 6} == {1}


def test_activation_never_asks_too_much():
    rng = np.random.default_rng(3)
    for percent, extra in ((90, 1.0), (80, 0.5), (50, 0.0)):
        for n in range(1, 60):
            for b in range(-(-percent * n // 100), n + 1):
                tokens = rng.permutation(n)
                for held in (np.sort(tokens[:b]), np.arange(b), np.arange(n - b, n)):
                    shared = np.intersect1d(held[: similar.head_length(b, percent, extra)], np.arange(similar.head_length(n, percent, extra)))
                    assert len(shared) >= max(similar.head_need(n, percent, extra), similar.head_need(b, percent, extra))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {50: 50, 55: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window):
    first = {}
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in texts:
        for j in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


@pytest.mark.parametrize(("window", "rounds"), [(50, 2), (50, 1), (26, 1), (32, 2)])
def test_repeats(docs, awkward, none, window, rounds):
    found = repeats.without_repeats(docs, window, rounds).collect()
    assert key(map(tuple, found)) == key(brute_repeats(awkward, window))
    assert repeats.without_repeats(none).count() == 0


def test_repeats_of_exact_length(spark):
    """Shared stretches of 49 and 50 words in changing surroundings, and texts of one word."""
    rows = []
    for i in range(40):
        piece = prose(1000 + i % 7, 49 + i % 3)
        rows.append((i, prose(i, 5 + i) + " " + piece + " " + prose(50 + i, 7)))
    rows += [(100 + i, "go " * (48 + i)) for i in range(5)] + [(200 + i, ("a b " * 40)[: 150 + i]) for i in range(4)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=True).collect()
    assert key(tuple(r)[:4] for r in found) == key(brute_repeats(rows, 50))
    assert all(sha(r.kept_text) == r.kept_sha256 for r in found)
    with pytest.raises(ValueError, match="window"):
        repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20))
def test_symbols_stand_for_their_words(core, before, after):
    """Equal names have equal words, whatever surrounds them; one long run is one symbol; every symbol is wider than its parts."""
    words = np.random.default_rng(1).integers(0, 2**63, 5).astype(np.uint64)
    spoken = {}
    for text in (core, before + core + after, core * 3, [*core, 4, *core]):
        name, first, end, left, right = repeats.climbed(words[text], np.zeros(len(text), int), 2)
        for n, a, b in zip(name.tolist(), first.tolist(), end.tolist(), strict=True):
            assert spoken.setdefault(n, text[a:b]) == text[a:b] and b - a >= 2
    name, first, end, left, right = repeats.climbed(words[[1] * len(core)], np.zeros(len(core), int), 2)
    assert len(name) == (len(core) > 1) and (len(core) == 1 or (first[0], end[0], right[0]) == (0, len(core), len(core)))
    both = repeats.climbed(words[core + core], np.repeat([0, 1], len(core)), 1)
    assert all(b <= len(core) or a >= len(core) for a, b in zip(both[1], both[2], strict=True))


def test_repeats_of_rows_of_one_id(spark):
    """Texts of one id: what goes from one stays in the others, and none removes another's words."""
    base = prose(70, 160)
    rows = [(1, base), (5, prose(71, 30) + " " + base + " " + prose(72, 90)), (5, prose(73, 300)), (5, base), (5, prose(74, 60) + " " + prose(73, 300)), (9, prose(75, 9) + " " + prose(73, 300) + " " + base)]
    rows += [(20 + i, "go " * (60 + i) + prose(76, 55)) for i in range(6)] + [(40 + i, prose(70 + i % 2, 160) + " " + prose(90 + i, 60)) for i in range(12)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert key(map(tuple, found)) == key(brute_repeats(rows, 50))


# ---- decontamination -----------------------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window=10):
    out = []
    for i, t, *_ in rows:
        w = ALNUM.findall(lower(t))
        hit, names = set(), set()
        for item, text in items:
            v = ALNUM.findall(lower(text))
            n = min(window, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    names.add(item)
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(map(str, names)))), bool(hit)))
    return out


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_contamination(spark, docs, awkward, none, monkeypatch, broadcast_rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    words = awkward[3][1].split()
    items = [(1, " ".join(words[20:45])), (2, "ONE, two"), (3, None), (4, ""), (10, " ".join(awkward[0][1].split()[5:15])), (11, prose(99, 40)), (12, "one two three"), (13, "the the"), (2, " ".join(words[60:72])), (14, " ".join(awkward[20][1].split()[7:13])), (15, " ".join(awkward[21][1].split()[30:80])), (16, "hello")]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, doc_id string").repartition(3)
    found = decontaminate.digests(decontaminate.contamination(docs, bench)).collect()
    assert key(map(tuple, found)) == key(brute_contamination(awkward, items))
    assert decontaminate.contamination(none, bench).count() == 0
    assert {r.contaminated for r in decontaminate.digests(decontaminate.contamination(docs, bench.limit(0))).collect()} == {False}


def test_contamination_of_rows_of_one_id(spark):
    """Two texts of one id and of one length stay apart; items have names that aren't numbers, or none."""
    one, two = prose(31, 27).split(), prose(32, 27).split()
    rows = [(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(one)), (None, " ".join(two))]
    items = [("b-7", " ".join(one[2:24])), ("a", " ".join(two[5:])), (None, " ".join(two[9:20])), ("long", " ".join(one * 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = decontaminate.digests(decontaminate.contamination(df, spark.createDataFrame(items, "item_id string, text string"))).collect()
    expected = []
    for r, (_, t) in zip(brute_contamination(rows, items), rows, strict=True):
        named = sorted(i for i, x in items if i and brute_contamination([(0, t)], [(i, x)])[0][5])
        expected.append((*r[:4], sha(",".join(named)), r[5]))
    assert key(map(tuple, found)) == key(expected)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.integers(1, 8))
def test_winnowing_keeps_each_windows_smallest(values, w):
    h = np.array(values, np.uint64)
    expected = {i + int(h[i : i + w].argmin()) for i in range(len(h) - w + 1)}
    assert set(decontaminate.winnowed(h, w).tolist()) == expected
    assert repeats.winners(h, w).tolist() == [i + int(h[i : i + w].argmin()) for i in range(max(0, len(h) - w + 1))]


def test_simple8b_reads_block_offsets():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 5000).astype(np.uint64)
    ids[rng.random(5000) < 0.05] = 1 << 61  # escapes, whose raw words have a selector's bits of their own
    ids[rng.random(5000) < 0.05] |= np.uint64(1 << 63)
    words, blocks = simple8b.encode(ids)
    assert (simple8b.decode(words, blocks, 1, 3) == ids[1024:3072]).all() and (simple8b.decode(words, blocks, 4) == ids[4096:]).all()
    assert len(simple8b.decode(words, blocks, 2, 2)) == 0 and len(simple8b.decode(words[:0], blocks[:1])) == 0
    spoilt = words.copy()
    spoilt[blocks[2] :] = 0  # what other blocks hold is not read
    assert (simple8b.decode(spoilt, blocks, 0, 2) == ids[:2048]).all()
    for wrong in (blocks + 1, blocks[:-1], np.r_[blocks[:2], blocks[2] + 1, blocks[3:]], np.r_[0, blocks], blocks[::-1]):
        with pytest.raises(ValueError):
            simple8b.decode(words, wrong)


# ---- language ------------------------------------------------------------------------------------------------------------------


def test_language(spark):
    found = queries.op9_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").df()
    both = found.merge(truth, on="doc_id")
    assert (both.held_out == [held_out(i) for i in both.doc_id]).all() and both.score.between(0, 1).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.97


def test_language_edges(docs, awkward, none):
    found = {r.doc_id: r for r in language.identified(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (6, 7, 8))
    assert found[1].lang_pred != "und" and found[15].lang_pred != "und"
    assert language.identified(none).count() == 0
    assert {r.lang_pred for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rare_languages_are_learned(spark, monkeypatch):
    """Few rows of some languages beside many, most without an id: all languages are known, and few rows are collected."""
    learned, train = [], language.train
    monkeypatch.setattr(language, "train", lambda rows, *a, **b: learned.append(rows) or train(rows, *a, **b))
    rows = [(None if i % 2 else i, prose(i, 12), "de" if i % 3 else "en") for i in range(3000)]
    rare = {"el": "αβγδεζηθικλμ", "he": "אבגדהוזחטיכל", "ka": "აბგდევზთიკლმ"}
    for n, (name, script) in enumerate(rare.items()):
        rows += [(10_000 + 100 * n + i, " ".join(script[(i + j) % 9 :][:4] for j in range(9)), name) for i in range(12)]
    rows += [(None, f"{i} !?", "zz") for i in range(500)]
    found = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), 200).collect()
    assert len(found) == len(rows)
    assert {lang for lang, *_ in learned[0]} == {"de", "en", *rare} and len(learned[0]) <= 2 * 200 + 5
    assert all(r.lang_pred == list(rare)[(r.doc_id - 10_000) // 100] for r in found if (r.doc_id or 0) >= 10_000)


def test_each_class_is_learned_not_only_kept():
    for seed in range(20):
        rows = [("a", np.array([1, 2]), np.ones(2))] * 60 + [("b", np.array([7, 8]), np.ones(2))]
        assert language.train(rows, np.ones(language.DIMS), 61, seed=seed).weights()[7, 1] > 0


def test_elastic_net_gives_zeros():
    rng = np.random.default_rng(0)
    rows = [("a" if i % 2 else "b", np.array([1 + i % 2, *rng.choice(np.arange(10, 200), 5, False)]), np.ones(6)) for i in range(300)]
    model = language.train(rows, np.ones(language.DIMS), 300)
    w = model.weights()
    assert (w[300:400] == 0).all() and abs(w[1]).max() > 5 * np.median(abs(w[10:200])) and model.temperature > 0


# ---- tokens --------------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1), st.just(0)), max_size=600))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, blocks = simple8b.encode(ids)
    assert (simple8b.decode(words, blocks) == ids).all() and len(words) <= 2 * len(ids)
    for b in range(len(blocks) - 1):
        lo = b * simple8b.BLOCK
        assert (simple8b.decode(words, blocks, b, b + 1) == ids[lo : lo + simple8b.BLOCK]).all()
    assert (tokens.unpack(tokens.pack(ids)) == ids).all()


def test_simple8b_packs():
    for values, per_word in ((np.zeros(4800), 60), (np.ones(6000), 50), (np.full(6000, 30_000), 3.9), (np.full(6000, 2**61), 0.5)):
        words, _ = simple8b.encode(values.astype(np.uint64))
        assert len(values) / len(words) >= per_word


def text_hash(text):
    """Spark's xxhash64 of a text or null."""
    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (h >> 63 << 64)


def test_tokens_of_one_id(spark):
    """A third of the rows have one id, and some of them one text: they spread over the shards."""
    rows = [(7, prose(i % 90, 40)) for i in range(150)] + [(7, "same text")] * 150 + [(i, prose(i, 30)) for i in range(600)]
    files = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), queries.vocabulary(), shards=9)
    per_shard = [r["n"] for r in files.groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(per_shard) == len(rows) and max(per_shard) <= 0.2 * len(rows)
    found = sorted(tokens.read_tokens(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False))


def test_tokens(spark, docs, awkward, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.vocabulary())
    files = tokens.write_tokens(docs, queries.vocabulary(), shards=3)
    found = sorted(tokens.read_tokens(files).collect(), key=lambda r: r.start)
    expected, start = [], 0
    for i, t, *_ in sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == expected
    assert tokens.read_tokens(tokens.write_tokens(none, queries.vocabulary())).count() == 0


def test_a_worker_encodes_bounded_pieces(monkeypatch):
    """What a worker holds at once is about 1 MB of text and the ids of half a million words."""
    import pyspark

    sizes, encode = [], tokens.Encoder.encode
    monkeypatch.setattr(tokens.Encoder, "encode", lambda self, column: (sizes.append(len(common.utf8(column)[0])), encode(self, column))[1])
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([f"word {i} " * 40_000 for i in range(10)])], names=["doc_id", "text"])
    found = [r for b in tokens.segments(iter([batch]), queries.vocabulary(), 0) for r in b.to_pylist()]
    assert [i for r in found for i in r["doc_ids"]] == list(range(10)) and sum(sizes) == 2_800_000
    assert max(sizes) <= 1 << 20 and tokens.KNOWN_WORDS <= 500_000


def test_known_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 50)
    coder = tokens.Encoder(queries.vocabulary())
    for seed in range(4):
        texts = [prose(seed * 10 + i, 40) for i in range(3)] + ["a  b", "x. y, 3. don't, ... ,", "", " a", "a ", "a\u2003 \u2003b \u00a0c", "\u00ab na\u00efve. \u00bb. \u4e2d\u6587, x\n y", "<|endoftext|> z", "\x1c \x1d q"]
        ids, counts = coder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [coder.model.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9.,'!\n\t\u00e9\u00bb\u2003\u3000\u4e2d\u0301\U0001f600", max_size=25), max_size=6))
def test_encoder_is_the_tokenizer(texts):
    coder = tokens.encoder(queries.vocabulary())
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(coder.model.encode(t, add_special_tokens=False).ids) for t in texts]
    assert ids.tolist() == [i for t in texts for i in coder.model.encode(t, add_special_tokens=False).ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"as Z9.,'%!_\n\n\r\t\x1c\u0085\u00a0\u00e9\u00df\u00d7\u00f7\u00bb\u0117\u2003\u3000\u4e2d", "\n\n", "%%%%%%%%%", ".\n", "'s", "<|endoftext|>"]), max_size=20).map("".join), max_size=6))
def test_lines_and_punctuation_are_the_tokenizers(texts):
    coder = tokens.encoder(queries.vocabulary())
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    expected = [coder.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def words_met(monkeypatch):
    """How many words go to the model, by call."""
    met, learn = [], tokens.Encoder.learn
    monkeypatch.setattr(tokens.Encoder, "learn", lambda self, *given: (met.append(len(given[-1])), learn(self, *given))[1])
    return met


def test_words_are_known_without_lines_and_punctuation(monkeypatch):
    """Every pair of 40 words around a line's end, with any of 8 marks, is made of the words, capitals and marks alone."""
    met = words_met(monkeypatch)
    stems = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 5)) + "\u00e9" * (i % 2) for i in range(40)]
    marks = ["", ".", ",", "!!", "%%%", ".***", "'", "$$$"]
    texts = [" ".join(f"{a}{m}\n{b}{m}" for a in stems for b in stems) for m in marks]
    coder = tokens.Encoder(queries.vocabulary())
    ids, counts = coder.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in coder.model.encode(t, add_special_tokens=False).ids]
    assert sum(met) <= 2 * len(stems) + 1 + 2 * len(marks)


def test_common_words_stay_known(monkeypatch):
    """Words of every piece are learned about once, however many others come and go."""
    met = words_met(monkeypatch)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 2000)
    monkeypatch.setattr(tokens, "POOL_IDS", 20_000, raising=False)
    coder = tokens.Encoder(queries.vocabulary())
    for k in range(12):
        texts = [" ".join(f"w{i}x" for i in range(200)), " ".join(f"n{k}o{i}" for i in range(900))]
        ids, counts = coder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in coder.model.encode(t, add_special_tokens=False).ids]
    assert len(coder.pool) <= 40_000 and sum(met) <= 12 * 900 + 2 * 200


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello there.\nWhat? is%%% this", "", "a  b\n\nc", "\u00e9, x"]
    ids, counts = coder.encode(pa.array(texts))
    expected = [coder.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_long_words_do_not_fill_the_table():
    coder = tokens.Encoder(queries.vocabulary())
    texts = [f"{k}" + "0a" * 200_000 + " b" for k in range(3)]
    for t in texts:
        assert coder.encode(pa.array([t]))[0].tolist() == coder.model.encode(t, add_special_tokens=False).ids
    assert (coder.size <= tokens.LONGEST_KEPT).all()


# ---- shared pieces -----------------------------------------------------------------------------------------------------------------


def test_span_hashes_depend_on_content_alone():
    data = np.frombuffer(b"abc xabc abcd\x00", np.uint8)
    h = common.span_hashes(data, np.array([0, 5, 9, 9, 13]), np.array([3, 8, 12, 13, 14]))
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 3


def test_words_over_text_borders():
    words = common.Words(pa.array(["ab", "", "cd ef", " ", "g"]))
    assert np.diff(words.first).tolist() == [1, 0, 2, 0, 1]
    assert [bytes(words.data[a:b]) for a, b in zip(words.start, words.end, strict=True)] == [b"ab", b"cd", b"ef", b"g"]
