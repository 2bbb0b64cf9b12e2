"""Numpy kernels against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import common, licenses, media, quality, token_counts, wordbpe
from lexmill.llm.common import flat
from lexmill.llm.queries import PIECE_BPE, WORD_BPE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    pool = "aAb Bc\n\t  \x0b#$|é日 \x1c\xa0"
    some = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    words = ["the", "and", "of", "Größe", "x$", "und|", "a"]
    some += [" ".join(rng.choice(words[: rng.randint(1, 7)]) for _ in range(rng.randint(0, 150))) for _ in range(100)]
    some += ["\n".join(rng.choice(["one line here", "two", " ", "", "one line here "]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    return [*some, None, "", " ", "\n\n", "w " * 3000]


def brute_quality(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_counts():
    some = texts()
    m = quality.measure(*flat(pa.array(some)))
    got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute_quality(x or "") for x in some]


def test_quality_shares():
    some = texts(6)
    m = quality.measure(*flat(pa.array(some)))
    for i, text in enumerate(some):
        words = WORD.findall(text or "")
        whole = max(1, sum(map(len, words)))
        for n in range(2, 11):
            grams = [tuple(words[j : j + n]) for j in range(len(words) - n + 1)]
            if n in quality.TOP:
                top = max((c * sum(map(len, g)) for g, c in Counter(grams).items() if c >= quality.TOP_COPIES), default=0)
                assert m[f"top_{n}"][i] == pytest.approx(min(1, top / whole))
            if n in quality.DUPLICATED:
                seen, inside = set(), set()
                for j, g in enumerate(grams):
                    if g in seen:
                        inside |= set(range(j, j + n))
                    seen.add(g)
                assert m[f"dup_{n}"][i] == pytest.approx(sum(len(words[j]) for j in inside) / whole)


def test_groups_with_equal_upper_bits():
    keys = np.array([8, 9, 8, 9, 8, 3], np.uint64)
    order, fresh = common.groups(keys)
    assert [sorted(x.tolist()) for x in np.split(order, fresh[1:])] == [[5], [0, 2, 4], [1, 3]]


def brute_base(text: str) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), [i for i, _ in sorted(found)], {x for _, x in found}


def test_license_base():
    rng = random.Random(2)
    pool = "under the MIT license License, apache version 2 2.0 CC BY-NC by nc é_ x 日本\n".split(" ")
    for _ in range(400):
        text = rng.choice([" ", "-", "  "]).join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        words = text.encode().translate(licenses._FOLD).split()
        folded = b" " + b" ".join(words) + b" "
        base = licenses.base_places(folded)
        n, at, labels = brute_base(text)
        assert (len(words), sorted(folded.count(b" ", 0, p) - 1 for p, _ in base), {x for _, x in base}) == (n, at, labels)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2"}),
        ("Released under the MIT License.", {"mit"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("no permission here, only a commit message about isolation", set()),
    ],
)
def test_license_rules(text, labels):
    folded = b" " + b" ".join(text.encode().translate(licenses._FOLD).split()) + b" "
    assert {x[2] for x in licenses.detect(folded)} == labels
    assert len(licenses.RULES) > 300


def pattern_samples(tree) -> list[str]:
    """Strings that a parsed pattern matches: every alternative, with and without each optional part."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name in ("LITERAL", "CATEGORY"):
            ends = [chr(arg)] if name == "LITERAL" else ["1" if "DIGIT" in str(arg) else "a"]
        elif name == "IN":
            ends = ["x"] if str(arg[0][0]) == "NEGATE" else [x for item in arg for x in pattern_samples([item])]
        elif name == "NOT_LITERAL":
            ends = ["x"]
        elif name == "BRANCH":
            ends = [x for branch in arg[1] for x in pattern_samples(branch)]
        elif name == "SUBPATTERN":
            ends = pattern_samples(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            ends = [x * n for n in {low, min(high, low + 1)} for x in pattern_samples(inner)]
        else:
            ends = [""]  # looks around, takes nothing
        out = list(dict.fromkeys(a + b for a in out for b in ends))
    return out


def test_license_gates_lie_in_all_that_their_rules_match():
    for label, gate, pattern in licenses.NAMES + licenses.BODIES + licenses.SHORT:
        for sample in pattern_samples(re._parser.parse(pattern)):
            assert gate in f" {sample} ", (label, gate, sample)
            if (label, gate, pattern) not in licenses.SHORT:  # those stand behind "license" or "under"
                assert any(x in f" {sample} ".encode() for x in licenses._MAIN), (label, sample)


@pytest.mark.parametrize(
    ("text", "label"),
    [("licensed under CDDL 1.0", "cddl-1.0"), ("CDDL-1.1", "cddl-1.1"), ("released under ODbL 1.0", "odbl-1.0"), ("License: MS-PL", "ms-pl"), ("MS-RL", "ms-rl"), ("under the PSF license", "python-2"), ("under the Expat license", "mit")],
)
def test_license_short_names_pass_their_gates(text, label):
    folded = b" " + b" ".join(text.encode().translate(licenses._FOLD).split()) + b" "
    assert {x[2] for x in licenses.detect(folded)} == {label}


IDENTIFIERS = {
    "mit": "MIT", "mit-0": "MIT-0", "apache-2": "Apache-2.0", "apache-1.1": "Apache-1.1", "apache-1.0": "Apache-1.0", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause",
    "bsd-4-clause": "BSD-4-Clause", "0bsd": "0BSD", "agpl-3": "AGPL-3.0", "lgpl-2.1": "LGPL-2.1", "lgpl-3": "LGPL-3.0", "lgpl-2": "LGPL-2.0", "lgpl": "LGPL", "gpl-3": "GPL-3.0", "gpl-2": "GPL-2.0",
    "gpl-1": "GPL-1.0", "gpl": "GPL", "gfdl": "GFDL-1.3", "mpl-2": "MPL-2.0", "mpl-1.1": "MPL-1.1", "mpl-1.0": "MPL-1.0", "epl-2": "EPL-2.0", "epl-1": "EPL-1.0", "edl-1": "EDL-1.0",
    "cddl-1.1": "CDDL-1.1", "cddl-1.0": "CDDL-1.0", "cpl-1.0": "CPL-1.0", "cpal-1.0": "CPAL-1.0", "isc": "ISC", "zlib": "Zlib", "libpng": "libpng-2.0", "bsl-1.0": "BSL-1.0", "busl-1.1": "BUSL-1.1",
    "sspl-1": "SSPL-1.0", "elastic-2": "Elastic-2.0", "artistic-2": "Artistic-2.0", "artistic-1": "Artistic-1.0", "python-2": "Python-2.0", "php-3.01": "PHP-3.01", "ruby": "Ruby", "perl": "Perl",
    "unlicense": "Unlicense", "wtfpl": "WTFPL", "cc0-1.0": "CC0-1.0", "upl-1.0": "UPL-1.0", "ms-pl": "MS-PL", "ms-rl": "MS-RL", "eupl-1.2": "EUPL-1.2", "eupl-1.1": "EUPL-1.1", "osl-3": "OSL-3.0",
    "afl-3": "AFL-3.0", "ecl-2": "ECL-2.0", "ofl-1.1": "OFL-1.1", "odbl-1.0": "ODbL-1.0", "odc-by-1.0": "ODC-By-1.0", "pddl-1.0": "PDDL-1.0", "ncsa": "NCSA", "postgresql": "PostgreSQL",
    "openssl": "OpenSSL", "vim": "Vim", "w3c": "W3C", "x11": "X11", "curl": "curl", "unicode": "Unicode-3.0", "intel": "Intel", "nasa-1.3": "NASA-1.3", "qpl-1.0": "QPL-1.0", "sleepycat": "Sleepycat",
    "zpl-2.1": "ZPL-2.1", "mulan-psl-2": "MulanPSL-2.0", "cecill-2.1": "CECILL-2.1", "openrail-m": "OpenRAIL-M", "llama": "llama3.1", "beerware": "Beerware", "jsr": "JRL", "cc-by": "CC-BY-4.0",
    "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nd": "CC-BY-ND-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-nc-sa": "CC-BY-NC-SA-4.0", "cc-by-nc-nd": "CC-BY-NC-ND-4.0",
}


@pytest.mark.parametrize("form", ["SPDX-License-Identifier: {}", "License: {}", "This file is licensed under {}.", "SPDX-License-Identifier: {}\nint main()"])
def test_license_identifiers_in_every_form(form):
    assert set(IDENTIFIERS) < {label for label, _, _ in licenses.NAMES}
    for label, name in IDENTIFIERS.items():
        folded = b" " + b" ".join(form.format(name).encode().translate(licenses._FOLD).split()) + b" "
        assert {x[2] for x in licenses.detect(folded)} == {label}, name


@pytest.mark.parametrize("text", ["distributed with perl", "a call provided by curl", "zlib and MIT students", "the GPL debate"])
def test_license_identifiers_alone_mean_nothing(text):
    folded = b" " + b" ".join(text.encode().translate(licenses._FOLD).split()) + b" "
    assert not licenses.detect(folded)


def odd_texts() -> list[str]:
    rng = random.Random(3)
    pool = [*"aAbBcÉéßΣσςİI 0123  \n\t \x1c\x85\xa0’日本語한글#$%&!.ﬁ", "ñ", " ", "'s", "'t", "'re", "'ll", "''", "<|endoftext|>", "<|startoftext|>", "<|", "aaaa", "👩‍👧"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["", "aaaaaaaaaaaaa b", "ΑΣ ΣΑΣ", "it's <|endoftext|>x"]


def test_word_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, bpe = tokenizers.Tokenizer.from_file(WORD_BPE), wordbpe.load(WORD_BPE)
    some = odd_texts()
    for _ in range(2):  # the second time from what is kept
        ids, offsets = bpe.encode(some)
        decoded = bpe.decode(ids, offsets)
        for k, text in enumerate(some):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[offsets[k] : offsets[k + 1]].tolist() == want
            assert decoded[k].decode() == library.decode(want, skip_special_tokens=False)


def test_token_counts_at_cuts():
    model = token_counts.load(PIECE_BPE)
    for text in [*odd_texts(), "x" * 5000 + " y  z " * 300, " a" * 900, "▁ a ▁b" * 50, "  "]:
        assert sum(len(model.encode(x)) for x in token_counts.chunks(text, 30)) == len(model.encode(text))


def test_media_round_trip_and_resync():
    rng = random.Random(1)
    for n in (64, 128, 1408, 1472, 64 * 45, 64 * 900):
        body = rng.randbytes(n)
        stream = media.encode(body)
        s = media.scan(stream)
        assert media.payload(stream, s["offsets"], s["ends"], s["tags"]) == body
        assert s["table"] == {"kind": "Xing", "frames": len(s["offsets"]), "bytes": len(stream) - s["begin"], "toc": s["table"]["toc"]}
        assert media.check_sums(np.frombuffer(stream, np.uint8), s["sums"], [0] * len(s["sums"])).all()
        assert s["resyncs"] == 0 and s["samples"] == {32000: 1152 * len(s["offsets"])}
    cut = s["offsets"][5]
    broken = stream[:cut] + b"junk \xff\xfb junk" + stream[cut:] + b"TAG" + bytes(125)
    t = media.scan(broken)
    assert len(t["offsets"]) == len(s["offsets"]) and t["resyncs"] == 1 and "TAG" in t["tags"]
    flipped = bytearray(stream)
    flipped[cut + 8] ^= 1
    t = media.scan(bytes(flipped))
    assert (~media.check_sums(np.frombuffer(bytes(flipped), np.uint8), t["sums"], [0] * len(t["sums"]))).sum() == 1
    assert media.scan(b"") ["offsets"] == [] and media.scan(b"\xff" * 500)["offsets"] == []


@pytest.mark.parametrize("most", [7, 60, 1000])
def test_long_texts_in_pieces(monkeypatch, most):
    """Every kernel that cuts long texts gives what it gives for whole ones."""
    import tokenizers

    from lexmill.llm import jaccard, langid, lm

    texts = [*odd_texts(), None, "", "x" * 300, "the quick brown fox " * 90, "Straße \u03a3\u03a3 naïve café 日本 語 " * 40, "a  b\tc\nd 1 2 3 " * 60, "it's don't <|endoftext|> we'll " * 30, "one two three", "é\u0301 \u0301e " * 50]
    bpe, library = wordbpe.load(WORD_BPE), tokenizers.Tokenizer.from_file(WORD_BPE)
    masks = langid.Filter.empty(2, 1, 1 << 12)
    for k, t in enumerate(texts[:40]):
        own, *_ = langid.ngrams([t])
        langid.Filter.add(masks, own, np.full(len(own), k % 2))
    model = langid.Filter.of(["a", "b"], 1, masks)
    whole = model.decide(texts), [jaccard.shingles(*flat(pa.array([t or ""])), 5)[0] for t in texts]
    monkeypatch.setattr(common, "LONG", most)
    ids, offsets = bpe.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids
        assert sorted(jaccard.long_shingles(t or "", 5, most).tolist()) == sorted(whole[1][i].tolist()), t
    again = model.decide(texts)
    assert again[0] == whole[0][0] and again[1] == pytest.approx(whole[0][1])
    pieces, first = common.at_blanks(texts)
    n, _, _, count = lm._word_counts(*flat(pa.array(pieces, pa.string())))
    assert count.sum() == n.sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
