import pytest

from lectern.llm.sentences import p10_found, sentence_spans, sentences
from lectern.plans.runtime import table


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Vexal et al. (2019) saw it at 9 a.m. on Fig. 3.2.", " ", "It ended at 5 p.m.", " ", "Then they left."],
        ['He answered: "No."', " ", "It holds."],
        ['"Is it so? Really?" asked Prof. A. Fenn.', "  ", "(It ran twice. Both agree.)", " ", "pySweep ran 3.5 h."],
        ["»Det virker ikke. Prøv igen,« sagde dr. Hall.", " ", "Mødet var d. 3. maj kl. 9."],
        ["Siehe Kap. 9 bzw. Anhang B.", " ", "Am 3. Mai gilt z. B. Abb. 2.", "\n\n", "1 Methode", "\n\n", "„Gut. So.“", " ", "Im 19. Jh. nicht."],
        ["- one. Two", "\n", "- three", "\n", "2. four (a", "\n\n", "Tail (open.", " ", "Next."],
        ["他说:“好。再来！”", "这样够吗？", "“行吗？”评审问道。", "停顿……然后恢复。"],
        ["彼は「もう一度！」とだけ書いた。", "次だ。"],
        ["प्रो. ए. के. सिंह ने 0.2 लिए।", " ", "क्यों?!", " ", "ठीक।"],
        ["ปริภูมิ เช่น รางวัลและกำแพง ถูกอธิบาย", " ", "ตัวแทนใช้เวลา 3 ชั่วโมง"],
        ["«هذا لا يكفي. أعد»، كتب أ. د. كست.", " ", "هل؟", " ", "لا."],
        ["На с. 9 и др. карты, т. е. все.", " ", "«Нужна ли?» — спросил А. Кест."],
        ["EE. UU. no figura.", " ", "¿Basta?", " ", "No, no basta."],
    ],
)
def test_boundaries(parts):
    text = "".join(parts)
    want = [p for p in parts if p.strip()]
    assert [text[a:b] for a, b in sentence_spans(text)] == want


def test_everything_is_covered(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    open_ = {k: list(t or "") for k, t in texts.items()}
    for r in p10_found(spark, sf).collect():
        assert texts[r.doc_id][r.start_char : r.end_char].strip() == texts[r.doc_id][r.start_char : r.end_char] != ""
        open_[r.doc_id][r.start_char : r.end_char] = [" "] * (r.end_char - r.start_char)
    assert all("".join(t).strip() == "" for t in open_.values())


def test_edge_cases(spark):
    long = "A sentence here. " * 20_000
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t\n ", 3), (4, long, 4), (5, "a\r\n\r\nb", 5), (5, "a\r\n\r\nb", 5), (None, "x (y", 6), (7, '" ( „ unclosed. Then more.', 7), (8, "....!!!??", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_char int")
    got = sorted(((r.doc_id or 0), r.start_char, r.end_char) for r in sentences(df, "doc_id", "text").collect())
    assert got.count((5, 0, 1)) == 2 and (0, 0, 4) in got and (8, 0, 9) in got
    assert sum(k == 4 for k, _, _ in got) == 20_000 and not {1, 2, 3} & {k for k, _, _ in got}
    assert sentences(df.limit(0), "doc_id", "text").count() == 0
