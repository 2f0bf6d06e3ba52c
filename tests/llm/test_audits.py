"""License scans and the source divergence audit against plain versions."""

import collections
import random
import re

import numpy as np
import pytest

from sextant.llm import divergence, notices
from tests.llm.util import LOWER, ODD, empty, odd, wide

# License scans ------------------------------------------------------------------

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GPL = "This work is licensed under the GNU General Public License, version 3."
NOTED = [
    (101, GPL, "en", "a", 0),
    (102, "x " + GPL.replace("Public", "Pubic") + "\n\nReleased under the MIT Licenze", "en", "a", 0),
    (103, "cc-by CC BY, cc\nby. Licensed under CC BY-NC 4.0; cc byte", "en", None, 0),
    (104, "submit license, mit  licenses. mit-license!", "en", "b", 0),
    (105, "gnu general publiclicense and gnu gen eral public license, GNU lesser general public license", "en", "b", 0),
    (106, "Permission is hereby granted, free of charge, to any person obtaining copy of this software Apache License apache license", None, "b", 0),
    (107, "redistribution and use in source and binary forms with or without modification are permited " * 3, "en", "b", 0),
    (108, "Mit Licençe ünder the apache licensé, apache license", "fr", "b", 0),
    (108, "Mit Licençe ünder the apache licensé, apache license", "fr", "b", 0),
    (114, "eclipse publik license " + "filler words " * 4000 + "mozilla public license version 20", "en", "b", 0),
]


def distance(a, b, most):
    """Edits between two strings, or more than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def plain_hits(words, notice):
    """For each first word, the fewest edits of a run of words that begins there, where they are allowed."""
    out = {}
    for a in range(len(words)):
        run, best = "", notice.edits + 1
        for b in range(a, len(words)):
            run = run + " " + words[b] if run else words[b]
            if len(run) > len(notice.words) + notice.edits:
                break
            best = min(best, distance(run, notice.words, notice.edits))
        if best <= notice.edits:
            out[a] = best
    return out


def test_notices_are_those_of_brute_force(spark):
    rows = [*ODD, *NOTED]
    got = notices.scan(wide(odd(spark, rows))).collect()
    assert len(got) == len(rows) and "shard" in got[0].asDict()
    for r in got:
        low = (r.text or "").translate(LOWER)
        spans = [m.span() for m in ALNUM.finditer(low)]
        words = [low[a:b] for a, b in spans]
        assert r.n_words == len(words)
        for i, notice in enumerate(notices.NOTICES):
            mine = [m for m in r.matches if m.notice == i]
            if len(words) > 5000 and not mine and notice.label not in ("epl", "mpl"):
                continue  # the plain version is slow
            want = plain_hits(words, notice)
            assert {m.first_word: m.edits for m in mine}.items() <= want.items()
            # What isn't reported overlaps a match that is as good.
            for a, edits in want.items():
                assert any(m.first_word == a or edits and m.edits <= edits and a < m.end_word + notice.edits for m in mine)
            for m in mine:
                assert (m.begin, m.end) == (spans[m.first_word][0], spans[m.end_word - 1][1]) and m.label == notice.label
                assert distance(" ".join(words[m.first_word : m.end_word]), notice.words, m.edits) == m.edits


def test_a_fuzzy_notice_has_its_span():
    n, found = notices.Scanner().scan("Note: Permission is hereby granted, free of chrge, to any person obtaining a copy of this software.")
    assert n == 17 and [(m[1], m[4], m[5], m[6]) for m in found] == [("mit", 1, 1, 17)]
    assert found[0][7:] == (6, 98)


@pytest.mark.parametrize("seed", range(3))
def test_no_edited_notice_is_lost(seed):
    """Random edits up to the bound, in random surroundings."""
    dice, scanner = random.Random(seed), notices.Scanner()
    for i, notice in enumerate(notices.NOTICES):
        for _ in range(4):
            text = list(notice.words)
            for _ in range(dice.randint(0, notice.edits)):
                k = dice.randrange(1, len(text) - 1)
                how = dice.randrange(3)
                text[k : k + (how != 1)] = [dice.choice("abcxyz")] if how else []
            said = "".join(text)
            if not all(said.split(" ")):
                continue
            _, found = scanner.scan(f"before {said.upper()} after")
            assert any(m[0] == i for m in found), (notice, said)


def test_op11(spark, tmp_path):
    odd(spark, [*ODD, *NOTED]).write.parquet(f"{tmp_path}/documents.parquet")
    got = notices.op11_notices(spark, str(tmp_path)).collect()
    text = {i: t for i, t, *_ in [*ODD, *NOTED]}
    for r in got:
        words = ALNUM.findall((text[r.doc_id] or "").translate(LOWER))
        at = sorted((k, p.label) for p in notices.PHRASES for k in range(len(words)) if words[k : k + len(p.words.split())] == p.words.split())
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1.0 or not at) and (r.score > 0) == (r.labels != "")
    by = {r.doc_id: r for r in got}
    assert by[102].labels == "gpl,mit" and by[102].base_labels == "" and 0.9 < by[102].score < 1
    assert by[103].n_base == 4 and by[103].labels == "cc-by,cc-by-nc" and by[104].base_labels == "mit" and by[104].n_base == 1
    assert by[105].labels == "gpl,lgpl" and by[107].n_matches == 3 and by[104].labels == "mit"
    assert notices.scan(empty(spark)).collect() == []


# Source divergence ---------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least, top):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= least]
        mine = sorted(s for g, s in groups if g == lang)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in mine}
        q = share(sum((counts[lang, s] for s in mine), collections.Counter()))
        for s in mine:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def _mixed(n=400):
    dice = random.Random(4)
    pool = ["der", "die", "Über", "straße", "größe", "word", "Word", "naïve", "x2y", "ß", "😀", "a\x00b", "café", "zz" * 400, *[f"t{chr(97 + i)}" for i in range(26)]]
    rows = list(ODD)
    for i in range(n):
        source = dice.choice(["a", "a", "a", "b", "c", None, ""])
        rows.append((100 + i, None if i % 40 == 0 else dice.choice([" ", ", ", "7"]).join(dice.choices(pool, k=dice.randint(0, 30))), dice.choice(["en", "de", None]), source, 0))
    return [*rows, (9000, "", "fr", "only", 0), (9001, None, "nl", "p", 0), (9002, "12 34", "nl", "q", 0)]


@pytest.mark.parametrize(("least", "top", "block"), [(30, 50, 4096), (3, 4, 4096), (2, 50, 7)])
def test_audit_is_the_plain_one(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = _mixed()
    got = [tuple(r) for r in divergence.audit(wide(odd(spark, rows)), least, top).collect()]
    assert sorted(got) == plain_audit(rows, least, top)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(empty(spark)).collect() == []


def test_equal_hashes_do_not_join_different_slices():
    low = np.frombuffer(b"abc abd abc x abd abc yy", np.uint8)
    starts, ends, _ = divergence.slices(low, np.array([0, len(low)]))
    for hashed in (divergence.xxhash.xxh3_64_intdigest, lambda x: len(x), lambda x: 7):
        ids, shown = divergence.same_slices(low, starts, ends, hashed)
        words = [low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        assert len(shown) == len(set(words)) and [words[shown[i]] for i in ids] == words


def test_slices_stop_at_texts_and_long_ones_are_compared():
    data = np.frombuffer(b"abcdef", np.uint8)
    starts, ends, text = divergence.slices(data, np.array([0, 0, 3, 3, 6]))
    assert (starts.tolist(), ends.tolist(), text.tolist()) == ([0, 3], [3, 6], [1, 3])
    long = np.frombuffer((b"a" * (2 << 20)) + b" " + (b"a" * (2 << 20)) + b" " + b"a" * ((2 << 20) - 1) + b"b", np.uint8)
    starts, ends, _ = divergence.slices(long, np.array([0, len(long)]))
    assert divergence.same_slices(long, starts, ends, len)[0].tolist() == [0, 0, 1]
