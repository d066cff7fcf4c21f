"""Invented documents of known subjects for tests."""

from __future__ import annotations

WORDS = {
    "sport": ["cầu thủ trẻ", "trận đấu lớn", "huấn luyện viên", "đội tuyển quốc gia", "bàn thắng đẹp", "khán đài đông", "trọng tài biên", "mùa giải mới"],
    "law": ["hợp đồng lao động", "đơn khiếu nại", "điều khoản phạt", "khởi kiện dân sự", "tòa án tỉnh", "luật sư riêng", "bồi thường thiệt hại", "chứng cứ gốc"],
    "heart": ["van tim hở", "mạch vành hẹp", "nhịp tim nhanh", "huyết áp cao", "đau ngực trái", "siêu âm tim", "thuốc lợi tiểu", "suy tim nặng"],
}
FRAMES = ["Theo ghi nhận thì {} được nhắc nhiều cùng {} trong năm", "Kết quả cho thấy {} thay đổi khi có {} rõ rệt", "Nhóm tác giả nhận thấy {} và {} đi cùng"]


def topical(rng, n: int, subjects: int, rare: bool = False):
    """(rows (id, text), {id: subjects}, words). With rare, a document uses only three words of its subject, next to one another."""
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(WORDS), subjects)
        said = []
        for s in own:
            words = WORDS[s]
            if rare:
                at = rng.randrange(len(words))
                words = [words[(at + k) % len(words)] for k in range(3)]
            said += [rng.choice(FRAMES).format(*rng.sample(words, 2)) for _ in range(5)]
        docs.append((i, ". ".join(said) + "."))
        truth[i] = set(own)
    return docs, truth, WORDS
