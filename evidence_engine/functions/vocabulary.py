"""Fixed values of the legal domain: names, markers and sentences that results depend on."""

# Titles by document number.
DOCUMENT_TITLES = {
    "31-2024-QH15": "Luật Đất đai số 31/2024/QH15",
    "43-2024-QH15": "Luật số 43/2024/QH15 sửa đổi, bổ sung một số điều của Luật Đất đai, Luật Nhà ở, Luật Kinh doanh bất động sản và Luật Các tổ chức tín dụng",
    "45-2013-QH13": "Luật Đất đai số 45/2013/QH13",
    "254-2025-QH15": "Nghị quyết số 254/2025/QH15",
}

# Words that make a question a comparison, in each of the three routers.
FUSION_COMPARISON = ("so sánh", "khác nhau", "khác biệt", "đối chiếu")
PROMPT_COMPARISON = ("so sánh", "đối chiếu", "khác nhau", "khác biệt", "thay đổi", "điểm mới", "2013 và 2024", "2013 với 2024", "2024 và 2013", "2024 với 2013")
ROUTE_COMPARISON = ("so sánh", "đối chiếu", "khác nhau", "khác biệt", "thay đổi", "điểm mới")
ROUTE_PAST = ("trước đây", "trước kia", "luật cũ", "năm 2013")
ROUTE_PRESENT = ("hiện nay", "hiện hành", "năm 2024", "luật mới")

# Routing phrases that a topic loses.
TOPIC_PHRASES = (
    "so sánh", "đối chiếu", "khác nhau như thế nào", "khác nhau thế nào", "giữa luật đất đai 2013 và 2024", "giữa năm 2013 và 2024",
    "theo luật đất đai 2013 và luật đất đai 2024", "theo luật 2013 và 2024", "2013 và 2024", "2024 và 2013",
)

# What focus ranking looks for.
LEGAL_INTENTS = ("điều kiện", "thủ tục", "trình tự", "thời điểm", "thời hạn", "quyền", "nghĩa vụ", "bồi thường", "hỗ trợ", "thu hồi")
LEGAL_ACTIONS = (
    "chuyển nhượng quyền sử dụng đất", "chuyển đổi quyền sử dụng đất", "tặng cho quyền sử dụng đất", "thừa kế quyền sử dụng đất", "thế chấp quyền sử dụng đất",
    "góp vốn bằng quyền sử dụng đất", "cho thuê quyền sử dụng đất", "chuyển mục đích sử dụng đất", "cấp giấy chứng nhận",
)
LEGAL_SUBJECTS = {
    "cá nhân": ("cá nhân", "người sử dụng đất"),
    "hộ gia đình": ("hộ gia đình", "người sử dụng đất"),
    "tổ chức": ("tổ chức", "người sử dụng đất"),
    "doanh nghiệp": ("doanh nghiệp", "tổ chức kinh tế", "người sử dụng đất"),
}
FOCUS_STOPWORDS = (
    "so", "sánh", "theo", "luật", "đất", "đai", "năm", "pháp", "hiện", "hành", "để", "được", "và", "với", "giữa", "quy", "định", "của", "2013", "2024", "45", "31", "qh13", "qh15",
)
RIGHTS_PHRASES = ("người sử dụng đất được thực hiện", "người sử dụng đất được chuyển nhượng")
CONDITION_PHRASES = ("khi có các điều kiện", "khi có đủ các điều kiện", "các điều kiện sau đây")

# Headings of a comparison and sentences that answers carry verbatim.
COMPARISON_SECTIONS = ("1. Quy định năm 2013:", "2. Quy định hiện hành:", "3. Điểm giống:", "4. Điểm khác/thay đổi:")
NO_EVIDENCE = "Chưa đủ căn cứ trong dữ liệu truy xuất."
NO_COUNTERPART = "Chưa tìm thấy quy định tương ứng trong dữ liệu truy xuất."
BIBLIOGRAPHY = "Căn cứ pháp lý:"

# Spoken digits and number words.
SPOKEN_DIGITS = {"một": 1, "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9}
SPOKEN_OTHERS = ("mười", "mươi", "mốt", "lăm", "trăm", "nghìn", "ngàn", "linh", "lẻ", "không", "triệu")
SPOKEN_YEARS = {"hai nghìn không trăm hai mươi bốn": "2024", "hai nghìn không trăm mười ba": "2013"}

# Audio files that are accepted.
AUDIO_SUFFIXES = (".wav", ".mp3", ".m4a", ".ogg", ".webm", ".flac", ".mp4")
AUDIO_BYTES, AUDIO_SECONDS = 20 * 1024 * 1024, 120
