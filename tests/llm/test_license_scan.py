import random

from clonalyze.llm import license_scan as L

R = L.Recogniser()


def found(text):
    return R.licences(R.sentence_ids(text))


def mit(sep="\n\n"):
    s = L.SENTENCES
    return f"{s['mit-grant']}:{sep}{s['mit-notice']}.{sep}{s['as-is-mit']}. {s['no-liability-mit']}."


def wrapped(text, width=60):
    out, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_whole_texts_are_one_licence():
    assert found(mit()) == (["MIT"], [])
    assert found("Some words before\n" + wrapped(mit(" ")) + "\nand after.") == (["MIT"], [])
    bsd = " ".join(f"{L.SENTENCES[k]}:" if k == "bsd-grant" else f"{L.SENTENCES[k]}." for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert found(bsd) == (["BSD-2-Clause"], [])
    assert found(f"{bsd} {L.SENTENCES['bsd-endorse']}.") == (["BSD-3-Clause"], [])


def test_references():
    for text, spdx in [("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"),
                       ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
                       ("All rights reserved.", "all-rights-reserved"), ("// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause")]:
        assert found(text) == ([spdx], [])
        assert found(f"First line without end\n{text}\nNext line") == ([spdx], [])
        assert found(f"A sentence. {text} Another one.") == ([spdx], [])


def test_order_matters_and_fragments_remain():
    s = L.SENTENCES
    assert found(f"{s['bsd-source']}. {s['bsd-grant']}.") == ([], ["bsd-source", "bsd-grant"])
    assert found(f"{s['gpl-hope']}.") == ([], ["gpl-hope"])
    assert found(f"Released under the MIT License. {s['gpl-free']}. {s['gpl-hope']}. {s['gpl-details']}. {s['gpl-received']}.") == (["MIT", "GPL-3.0-or-later"], [])


def test_no_licence_in_other_text():
    for text in ["The MIT campus is large.", "a licensed under driver", "version 3.", "", "Licensed", "All rights are reserved for members."]:
        assert found(text) == ([], [])


def brute(text):
    """Every known sentence that is a whole run of words between sentence or line ends."""
    out = set()
    for key, i in R.known.items():
        if f" {key} " in " " + L.normalise(text) + " ":
            out.add(i)
    return out


def test_random_insertions_equal_brute_force():
    rnd = random.Random(8)
    keys = list(L.SENTENCES)
    for _ in range(100):
        parts = [rnd.choice(["Lorem ipsum dolor.", "Sit amet!\n", "\n\n"] + [L.SENTENCES[k] + "." for k in rnd.sample(keys, 3)]) for _ in range(6)]
        text = rnd.choice([" ", "\n"]).join(parts)
        assert set(R.sentence_ids(text)) == brute(text)


def test_table_nulls_repeats_names(rows):
    data = [(1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (None, None, None), (2, "", "b"), (3, "x " * 100_000 + ". " + mit(), "c")]
    out = L.scan(rows("doc_id long, text string, licenses string", data))
    assert out.columns == ["doc_id", "text", "licenses", "sentence_ids", "fragments"]
    assert sorted([(r["doc_id"], r["licenses"]) for r in out.collect()], key=repr) == sorted(
        [(1, ["MIT"]), (1, ["MIT"]), (None, []), (2, []), (3, ["MIT"])], key=repr)
    assert L.scan(rows("doc_id long, text string", [])).count() == 0


def test_padding_does_not_hide_a_sentence():
    words = L.SENTENCES["mpl-notice"].split()
    assert found((" " * 200).join(words) + ".") == (["MPL-2.0"], [])
    assert found(("*" * 3000).join(words) + ".") == (["MPL-2.0"], [])
    assert found("This " + "very " * 5000 + "long sentence.") == ([], [])


def test_spdx_expressions():
    for text, names in [("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
                        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"]),
                        ("/* SPDX-License-Identifier: (LGPL-2.1-only and (MIT or BSD-3-Clause)) */ code", ["LGPL-2.1-only", "MIT", "BSD-3-Clause"]),
                        ("SPDX-License-Identifier: MIT\nor Apache-2.0", ["MIT"]), ("SPDX-License-Identifier: GPL-3.0+ more words", ["GPL-3.0+"]), ("SPDX-License-Identifier:", [])]:
        assert found(text) == (names, []), text
