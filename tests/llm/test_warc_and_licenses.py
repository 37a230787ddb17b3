import gzip
import textwrap

import pytest

from shelfwise.llm import licenses, queries, warc
from shelfwise.llm.shared import new_folder
from shelfwise.llm.sql import ORACLE
from tests.compare import differences, duck
from tests.llm.conftest import SMALL

READY = [licenses.Template(k, t) for k, texts in licenses.TEMPLATES.items() for t in texts]


def test_the_warc_query_equals_its_sql(spark):
    problems, rows, _ = differences(queries.op9_warc(spark, SMALL), duck(SMALL), ORACLE["op9_warc"])
    assert rows and not problems


def test_archives_round_trip_with_copies_nulls_and_small_blocks(spark):
    page = "<html>é" + "x" * 500
    rows = [(1, "http://a", page), (2, "http://b\r\n", page), (3, None, None), (4, "u", ""), (5, "u", "own"), (1, "http://a", page),
            (None, "n", page), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, archive string")
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder, archive_bytes=300)
    assert index.count() == len(rows) and index.select("archive").distinct().count() > 1
    got = warc.read_records(index, folder, task_bytes=200, gap=0, span=400).collect()
    response = {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert response == {(1, page.encode()), (3, b""), (5, b"own"), (None, b"alone")}
    revisit = sorted((str(r.page_id), r.refers_to, r.payload_bytes) for r in got if r.record_type == "revisit")
    assert revisit == [("2", 1, len(page.encode())), ("4", 3, 0), ("None", 1, len(page.encode()))]
    some = warc.read_records(index.where("page_id = 5"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"own"]
    larger = warc.read_records(warc.write_archives(pages, new_folder(spark, "warc-test"), min_bytes=1), folder, with_payload=False)
    assert larger.columns == warc.read_records(index, folder).columns
    assert warc.round_trip(pages.where("page_id = -1")).count() == 0


def test_records_are_gzip_members_of_their_own():
    packed = warc._record(7, "http://a", b"hello", 7, False, warc._digest(b"hello"))
    text = gzip.decompress(packed).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response") and text.endswith("hello\r\n\r\n")


def test_every_license_line_is_found_once(spark, small_docs):
    got = sorted((r.doc_id, r.start, r.end, r.license) for r in queries.op8_licenses(spark, SMALL).collect())
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = []
    for i, t in small_docs:
        for line, name in lines.items():
            at = (t or "").find(line)
            while at >= 0:
                want.append((i, at, at + len(line) - 1, name))
                at = (t or "").find(line, at + 1)
    assert got == sorted(want)


@pytest.mark.parametrize("text, names", [
    ("Copyright 2020 A\n" + licenses.TEMPLATES["MIT"][2].replace(" to ", "\nto ") + "\nmore", ["MIT"]),
    ("intro " * 100 + licenses.TEMPLATES["GPL-2.0"][0] + " outro" * 90, ["GPL-2.0"]),
    ("Licensed under the Apache License, Version 1.1.", []), ("a license to sing", []), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("", []), (None, [])])
def test_wordings(text, names):
    assert [f[0] for f in licenses.scan(text, READY, 0.4, 0.1)] == names


NOTICE = "Copyright (c) 2020 Jane Doe, Example Corp. All rights reserved. Released under the MIT License."


@pytest.mark.parametrize("text, names", [
    (NOTICE, ["MIT"]), ("some words of " * 5 + NOTICE, ["MIT"]), ("many words without an end " * 40 + NOTICE, ["MIT"]),
    ("# " + licenses.TEMPLATES["MPL-2.0"][0].replace("Mozilla Public License", "Mozilla Public\n# License"), ["MPL-2.0"]),
    ("Code is released under the MIT License, its texts are licensed under CC BY 4.0", ["MIT", "CC-BY-4.0"]),
    (licenses.TEMPLATES["GPL-3.0"][1] + " " + licenses.TEMPLATES["GPL-2.0"][0], ["GPL-3.0", "GPL-2.0"])])
def test_notices_are_found_wherever_lines_and_sentences_end(text, names):
    assert [f[0] for f in licenses.scan(text, READY, 0.4, 0.1)] == names


@pytest.mark.parametrize("width", range(20, 100, 7))
def test_every_template_is_found_at_any_line_width(width):
    for t in READY:
        lines = "\n * ".join(textwrap.wrap(t.text, width, break_long_words=False, break_on_hyphens=False))
        found = licenses.scan(f"/*\n * {lines}\n */\ncode()", READY, 0.4, 0.1)
        assert [(f[0], f[4]) for f in found] == [(t.license, [])]


def test_an_edited_wording_tells_its_differences():
    text = licenses.TEMPLATES["ISC"][0].replace("any purpose", "any lawful purpose")
    found = licenses.scan(text, READY, 0.4, 0.1)
    assert [(f[0], f[4]) for f in found] == [("ISC", ["+lawful"])]


def test_odd_rows(odd, none):
    assert licenses.licenses(odd).count() == 0 and licenses.licenses(none).count() == 0
