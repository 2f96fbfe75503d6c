from lectern.llm.scans import CONFUSIONS, corrections, fold, p2_found, page_line, repaired, scan_noise
from lectern.plans.runtime import table

WORDS = [("the", 900), ("environment", 60), ("learner", 60), ("policy", 50), ("reads", 40), ("value", 40), ("based", 40), ("trade", 30), ("off", 60)]
DDL = "src string, paper_id string, text string"


def filler():
    body = " ".join(w for w, n in WORDS for _ in range(n)) + "\n" + "value-based trade-off " * 30
    return ("f", "filler", body)


def test_pages():
    assert all(map(page_line, ["Page 3", " - 12 -", "[l]", "xiv", "· 4 ·", "Page 2 of 9", "Side 3", "p. 7"]))
    assert not any(map(page_line, ["", "22 0.24 0.71", "Table 3", "3 Method", "in", "the"]))


def test_marks_and_repair(spark):
    text = "\n".join(["The Long Walk of the Learner: A Study", "A. Name", "", "The pol1cy reads the envi-", "Page 2", "\fThe Long Walk of the", "", "ronment. The value-", "based learrier lear ner reads.", "", "Next tbe policy."])
    got = {(r.line_no, r.kind) for r in scan_noise(spark.createDataFrame([filler(), ("s", "p", text), ("s", "n", None), ("s", "e", ""), ("s", "p", text)], DDL)).where("src = 's'").collect()}
    assert got == {(4, "ocr"), (4, "hyphen"), (5, "page"), (6, "header"), (9, "ocr"), (11, "ocr")}
    fixed = repaired(spark.createDataFrame([filler(), ("s", "p", text)], DDL)).where("src = 's'").first().text
    assert fixed.endswith("The policy reads the environment. The value-based learner learner reads.\n\nNext the policy.")


def test_corrections(spark):
    words = [("learner", 100), ("learrier", 3), ("1earrier", 2), ("environment", 50), ("environrnent", 2), ("ease", 40), ("case", 60), ("xx", 1), (None, 5), ("", 2), ("reward", 30), ("rewarcl", 1)]
    got = {r.word: r.correction for r in corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"learrier": "learner", "1earrier": "learner", "environrnent": "environment", "rewarcl": "reward"}
    assert corrections(spark.createDataFrame([], "word string, n long")).count() == 0
    # two misreadings, in either order or one made by the other; long words; characters of any plane
    long = "lautverschiebungs" * 4
    words = [("hochwasser", 90), ("hoclivvasser", 1), ("harmony", 80), ("liarrnony", 1), (long, 50), (long.replace("s", "5", 1), 1), ("環境環境", 60), ("barn", 40), ("baгn", 1), ("learnt", 0)]
    got = {r.word: r.correction for r in corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"hoclivvasser": "hochwasser", "liarrnony": "harmony", long.replace("s", "5", 1): long, "baгn": "barn"}
    # a pair of characters beyond the plane of most scripts, as a confusion of its own
    got = corrections(spark.createDataFrame([("環境論", 60), ("環壙論", 1)], "word string, n long"), short_ratio=6.0, confusions=[("壙", "境")]).collect()
    assert [tuple(r) for r in got] == [("環壙論", "環境論")]


def test_injected_noise_is_found(spark):
    """Misreadings put into clean lines of the real texts are marked."""
    sf = "/root/testdata/sf0.01"
    clean = table(spark, sf, "experience_records").where("extracted_text is not null").select("paper_id", "extracted_text").collect()
    marked = {(r.paper_id, r.line_no) for r in p2_found(spark, sf).where("src = 'experience_records' and kind = 'ocr'").collect()}
    rows, put = [], set()
    for r in clean:
        lines = r.extracted_text.split("\n")
        for i, line in enumerate(lines, 1):
            long = [w for w in line.split()[:-1] if w.isalpha() and w.islower() and len(w) > 5 and "e" in w]
            if (r.paper_id, i) not in marked and i % 31 == 0 and long:
                lines[i - 1] = line.replace(long[0], long[0].replace("e", "c", 1), 1)
                put.add((r.paper_id, i))
        rows.append(("x", r.paper_id, "\n".join(lines)))
    got = {(r.paper_id, r.line_no) for r in scan_noise(spark.createDataFrame(rows, DDL)).where("kind = 'ocr'").collect()}
    assert len(put) > 20 and len(put & got) >= 0.9 * len(put)


def test_empty(spark):
    assert scan_noise(spark.createDataFrame([], DDL)).count() == 0
    assert all(fold(a) is not None for a, _ in CONFUSIONS)
