import random
import re

import pytest

from inkdex.llm import licenses


def brute(text):
    """Places of the phrases, from a character-by-character reading."""
    words, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            words.append(word)
            word = ""
    places = [(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return words, places


def as_regex(template):
    """The template as a regular expression over words that each end in a space."""
    out = []
    for t in re.findall(r"[\[\]()|]|\{\d+-\d+\}|[^\s\[\](){}|]+", template):
        if t in "[(":
            out.append("(?:")
        elif t == "]":
            out.append(")?")
        elif t in ")|":
            out.append(t)
        elif t[0] == "{":
            out.append("(?:[^ ]+ )" + t.replace("-", ","))
        else:
            out.append(re.escape(t) + " ")
    return re.compile("".join(out))


def longest(regex, words, at):
    ends = [k for k in range(at + 1, len(words) + 1) if regex.fullmatch("".join(w + " " for w in words[at:k]))]
    return max(ends, default=None)


def test_automata_equal_regular_expressions():
    rng = random.Random(6)
    templates = ["a [ b ] c", "a {0-2} b", "( a | b c ) [ d [ e ] ] f", "a {1-3} [ a b ] {0-1} c", "a ( b | [ c ] d ) a"]
    for template in templates:
        automaton, regex = licenses.Automaton(template), as_regex(template)
        for _ in range(300):
            words = [rng.choice("abcdef") for _ in range(rng.randrange(1, 9))]
            for at in range(len(words)):
                assert automaton.match([w.encode() for w in words], at) == longest(regex, words, at), (template, words, at)


def test_own_templates_accept_their_wording():
    for label, template in licenses.TEMPLATES.items():
        plain = re.sub(r"\{(\d+)-\d+\}", lambda m: "x " * int(m[1]), re.sub(r"\(([^|()]*)\|[^()]*\)", r"\1", template))
        while "[" in plain:
            plain = re.sub(r"\[[^\[\]]*\]", " ", plain)
        words = [w.encode() for w in plain.split()]
        assert licenses.automata()[label].match([*words, b"more"], 0) == len(words), label
        assert licenses.automata()[label].match(words[:-1], 0) is None or label in ("gpl-3.0", "gpl-2.0")
        if len(words) > 8:  # a changed word in the last mandatory clause is refused
            changed = [*words[:-3], b"changed", *words[-2:]]
            assert licenses.automata()[label].match(changed, 0) is None or label in ("gpl-3.0", "gpl-2.0"), label


def test_whole_licenses_and_tags():
    """Long licenses are accepted as published, with another address or without the appendix, and refused if a clause differs."""
    import pathlib

    where = pathlib.Path("/usr/share/common-licenses")
    for file, label in (("Apache-2.0", "apache-2.0-text"), ("GPL-2", "gpl-2.0-text"), ("GPL-3", "gpl-3.0-text"), ("LGPL-2.1", "lgpl-2.1-text"), ("MPL-2.0", "mpl-2.0-text")):
        if not (where / file).exists():
            continue
        text = (where / file).read_bytes()
        found = {m[0] for m in licenses.scan(b"before. " + text)[2]}
        assert label in found, (file, found)
        assert label not in {m[0] for m in licenses.scan(text.replace(b"warrant", b"guarant"))[2]}
        if file == "GPL-2":
            assert label in {m[0] for m in licenses.scan(text.replace(b"51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", b"59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"))[2]}
    tag = lambda t: {m[0] for m in licenses.scan(t)[2]}
    assert tag(b"// SPDX-License-Identifier: GPL-3.0-or-later\nint x;") == {"spdx-gpl-3.0"} and tag(b"SPDX-License-Identifier: MIT") == {"spdx-mit"}
    assert tag(b"Apache License\n Version 2.0, January 2004") == {"apache-2.0-title"} and tag(b"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007") == {"gpl-3.0-title"}


@pytest.mark.parametrize("bad", ["[ a ]", "a ]", "( a", "{1-2} a", ""])
def test_bad_templates_are_refused(bad):
    with pytest.raises(ValueError):
        licenses.Automaton(bad)


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["Licensed under CC BY-NC 4.0.", "the GNU General Public\nLicense, version 3.", "Apache License", "MIT license", "mit, License", "cc", "by", "word", "Émile", "under the"]
    rows = [(0, None), (1, ""), (2, "..."), (None, "MIT License"), (3, "MIT License"), (3, "MIT License"), (4, "word " * 30_000 + "mit license")]
    rows += [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for k in range(5, 80)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, labels string")
    want, own = [], {label: as_regex(t) for label, t in licenses.TEMPLATES.items() if len(t) < 400}
    for key, text in rows:
        words, places = brute(text)
        labels, covered = {p[0] for p in places}, set()
        for at in range(len(words)) if len(words) < 1000 else ():
            for label, regex in own.items():
                end = longest(regex, words[: at + 40], at)
                if end:
                    labels.add(label)
                    covered |= set(range(at, end))
        at = [p[1] for p in places]
        want.append((key, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({p[0] for p in places})),
                     ",".join(sorted(labels)), round(len(covered) / len(words), 9) if words else 0.0))
    got = [(*tuple(r)[:7], round(r.score, 9)) for r in licenses.label_documents(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.label_documents(df.limit(0)).collect() == []
