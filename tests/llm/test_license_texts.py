import textwrap
from pathlib import Path

from rollscan.llm import license_scan
from rollscan.llm.license_scan import KNOWN, scan_licenses

FOLDER = Path(license_scan.__file__).parent / "license_texts"


def whole(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r["whole_license"] for r in scan_licenses(d).orderBy("doc_id").collect()]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_titled_and_wrapped_short_texts(spark):
    heads = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License"}
    texts, want = [], []
    for k, t in KNOWN[:3]:
        for width in (60, 72, 76, 78, 80, 10_000):
            texts.append(f"{heads[k]}\n\nCopyright (c) 2020 Some Body\n\n{wrapped(t, width)}\n")
            texts.append(f"Copyright Some Body <a@b.c>\n\n{wrapped(t, width)}\n")
            want += [k, k]
    assert whole(spark, texts) == want


def test_entire_texts(spark):
    names = sorted(FOLDER.glob("*.txt"))
    assert whole(spark, [f.read_text("utf-8") for f in names]) == [f.stem for f in names]
    apache = (FOLDER / "Apache-2.0.txt").read_text("utf-8")
    bsd = (FOLDER / "BSD-3-Clause.txt").read_text("utf-8").replace("the University", "Some Body").replace("THE REGENTS", "SOME BODY")
    two = "BSD 2-Clause License\n\n" + bsd[: bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE") :]
    texts = [apache[: apache.index("END OF TERMS")], apache.replace("[yyyy] [name of copyright owner]", "2020 Some Body"), bsd, two]
    assert whole(spark, texts) == ["Apache-2.0", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause"]


def test_changed_text_is_another(spark):
    gpl = (FOLDER / "GPL-3.0.txt").read_text("utf-8")
    assert whole(spark, [gpl.replace("copyleft", "copyright")]) == [None]
