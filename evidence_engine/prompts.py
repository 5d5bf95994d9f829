"""What generators are told. Wording is this engine's own; labels, headings and fixed sentences are the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_engine.functions import vocabulary as V
from evidence_engine.functions.intents import prompt_intent

VERSION_RULES = {
    "current": "Chỉ dùng quy định hiện hành (Luật 31/2024/QH15 và văn bản sửa đổi) có trong EVIDENCE; không dùng Luật Đất đai 2013.",
    "2013": "Chỉ dùng EVIDENCE của Luật 45/2013/QH13; không pha trộn quy định hiện hành.",
    "comparison": "Trình bày riêng quy định năm 2013 và quy định hiện hành; không gán nội dung của phiên bản này cho phiên bản kia.",
}
RULES = (
    "Bạn trả lời câu hỏi về pháp luật đất đai Việt Nam, chỉ từ EVIDENCE đi kèm. Chọn đoạn đúng chủ thể, hành vi và đối tượng được hỏi; không cần dùng hết. "
    "Không dùng kiến thức bên ngoài, không thêm ví dụ hay suy luận, không nêu Điều, Khoản, Điểm hay tên văn bản không có trong EVIDENCE. {rule} "
    "Nếu EVIDENCE không đủ, trả lời đúng nguyên văn: '" + V.NO_EVIDENCE + "' "
    "Mỗi ý pháp lý nằm trên một dòng và kết thúc bằng nhãn [Nguồn n] của đoạn hỗ trợ nó. Không tự đặt số nguồn, không viết danh mục căn cứ, không dùng 'v.v.'."
)
ONE_SIDE = {
    (1, 2): "Dòng đầu mở bằng '1. Quy định năm 2013:' và chỉ dùng nhãn phía 2013; dòng hai mở bằng '2. Quy định hiện hành:' và chỉ dùng nhãn phía hiện hành.",
    (3, 4): "Dòng đầu mở bằng '3. Điểm giống:', dòng hai mở bằng '4. Điểm khác/thay đổi:'; mỗi dòng có ít nhất một nhãn của mỗi phía.",
}
ONE_SIDE[1, 2, 3, 4] = ONE_SIDE[1, 2] + " " + ONE_SIDE[3, 4]
COMPARE = (
    "Bạn đối chiếu hai phiên bản pháp luật đất đai, chỉ từ hai nhóm EVIDENCE đã tách riêng. Không suy đoán, không ghép hai quy định chỉ vì cùng số Điều, không tự viết tên văn bản hay số Điều. "
    "Mỗi dòng kết thúc bằng nhãn [Nguồn n] có sẵn. Xuất đúng {n} dòng theo thứ tự: {headings}"
)
TEMPLATES = {
    (1, 2): "1. Quy định năm 2013: <nội dung> [Nguồn n]\n2. Quy định hiện hành: <nội dung> [Nguồn n]",
    (3, 4): "3. Điểm giống: <nội dung> [Nguồn 2013] [Nguồn hiện hành]\n4. Điểm khác/thay đổi: <nội dung> [Nguồn 2013] [Nguồn hiện hành]",
}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def question_messages(query: Column, context: Column) -> Column:
    """Messages for a question; a blank one is an error."""
    intent = prompt_intent(query)
    rule = F.try_element_at(F.create_map(*[F.lit(x) for p in VERSION_RULES.items() for x in p]), intent)
    head, tail = RULES.split("{rule}")
    asked = F.when(F.trim(query) == "", F.raise_error(F.lit("empty question"))).otherwise(F.trim(query))
    shown = F.coalesce(F.nullif(context, F.lit("")), F.lit("[Không có evidence phù hợp]"))
    user = F.concat(F.lit("CÂU HỎI:\n"), asked, F.lit("\n\nCHẾ ĐỘ PHIÊN BẢN: "), intent, F.lit("\n\nEVIDENCE:\n"), shown, F.lit("\n\nGắn [Nguồn n] ở cuối từng ý."))
    return F.array(message("system", F.concat(F.lit(head), rule, F.lit(tail))), message("user", user))


def comparison_messages(query: Column, old: Column, new: Column, sections=(1, 2, 3, 4)) -> Column:
    """Messages for some sections of a comparison; old and new are contexts with labels that don't overlap."""
    sections = tuple(sections)
    if sections not in ONE_SIDE:
        raise ValueError("sections are (1, 2), (3, 4) or (1, 2, 3, 4)")
    checked = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(V.NO_COUNTERPART))).otherwise(c)
    labels = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"\[Nguồn\s+[0-9]+\]"), F.lit(0)), ", ")
    rules = COMPARE.format(n=len(sections), headings=" ".join(V.COMPARISON_SECTIONS[k - 1] for k in sections))
    user = F.concat(
        F.lit("CÂU HỎI:\n"), F.trim(query), F.lit("\n\nEVIDENCE LUẬT ĐẤT ĐAI 2013:\n"), checked(old), F.lit("\n\nEVIDENCE PHÁP LUẬT HIỆN HÀNH:\n"), checked(new),
        F.lit("\n\nNHÃN PHÍA 2013: "), labels(old), F.lit("\nNHÃN PHÍA HIỆN HÀNH: "), labels(new), F.lit(f"\n\nChỉ trả lời các mục {', '.join(map(str, sections))}. {ONE_SIDE[sections]}"),
    )
    return F.array(message("system", F.lit(rules)), message("user", user))


def retry_messages(before: Column, output: Column, sections) -> Column:
    """The messages before, what came of them, and the form that is wanted."""
    if tuple(sections) not in TEMPLATES:
        raise ValueError("retries are for sections (1, 2) or (3, 4)")
    wanted = F.lit("Kết quả trên sai cấu trúc. Viết lại từ EVIDENCE, không giải thích, đúng hai dòng theo mẫu:\n" + TEMPLATES[tuple(sections)])
    return F.concat(before, F.array(message("assistant", output), message("user", wanted)))
