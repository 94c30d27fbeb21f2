"""Scanned book pages: page filter, noise lines, headings, exercises, sections, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .segments import sections

# The patterns of Vietnamese schoolbooks. (?iu) folds letters with marks, too.
PAGE_FILE = r"\.pdf_(\d+)\.jpg\.txt$"
LESSON = r"(?iu)^(?:Bài|BÀI|BAI)\s*(\d{1,2})(?:\s*[:.\-]\s*(.*))?$"
LESSON_MARKER = r"(?iu)^(?:Bài|BÀI|BAI)$"
MAJOR_SECTION = r"(?iu)^(I|II|III|IV|V|VI|VII|VIII|IX|X)\s*[.\-]?\s+(.+)$"
NUMBERED_SECTION = r"^(\d{1,2})\s*[.)\-]\s+(.+)$"
EXERCISE_START = (
    r"(?iu)^(?:[-–•]\s*)?(?:[A-ZĐ]\s+)?(?:Câu hỏi|Cầu hỏi|Câu hỏi và bài tập|Bài tập|Hãy|Hãy nêu|Hãy trình bày|Nêu|Trình bày|Dựa vào|Vì sao|Tại sao|"
    r"Thế nào|Như thế nào|Lập niên biểu|Tìm hiểu|Em\s+(?:đánh giá|nghĩ|hiểu))(?![\p{L}\p{N}_])"
)
EXERCISE_ASK = r"(?iu)(?<![\p{L}\p{N}_])hãy\s+(?:nêu|trình bày|cho biết|phân tích)(?![\p{L}\p{N}_])"
EXERCISE_CUES = (
    r"(?iu)(như thế nào|thế nào|là gì|vì sao|tại sao|có gì|hãy|nêu|trình bày|cho biết|đánh giá|em nghĩ|vai trò|ảnh hưởng|"
    r"hoàn cảnh|diễn biến|nguyên nhân|ý nghĩa|bối cảnh|nội dung|kết quả|đặc điểm|lập niên biểu)"
)
EXERCISE_BLOCK = r"(?iu)(?<![\p{L}\p{N}_])(?:Câu hỏi|Cầu hỏi|Câu hỏi và bài tập|Bài tập)(?![\p{L}\p{N}_]).*$"
EXERCISE_QUESTION = (
    r"(?iu)(?:^|\s)(?:[-–•]\s*)?(?:[A-ZĐ]\s+)?(?:Hãy|Nêu|Trình bày|Dựa vào|Vì sao|Tại sao|Thế nào|Như thế nào|"
    r"Lập niên biểu|Tìm hiểu|Em\s+(?:đánh giá|nghĩ|hiểu))[^.?!]*\?"
)
QUESTION_HINT = (
    r"(?iu)[^.?!]{0,180}(?:như thế nào|thế nào|là gì|có gì|vai trò|ảnh hưởng|hoàn cảnh|diễn biến|nguyên nhân|ý nghĩa|bối cảnh|nội dung|"
    r"kết quả|đặc điểm)[^.?!]{0,120}\?"
)
PUBLICATION = (
    r"(?iu)(Chịu trách nhiệm xuất bản|Biên tập lần đầu|Biên tập tái bản|Biên vẽ|Biên vê|Trình bày bìa|Sửa bản in|Chế bản|CHẾ BẢN|Mã số|In xong|Bản quyền thuộc)"
)
PAGE_NUMBER = r"^\d{1,3}$"
FIGURE_OR_TABLE = r"(?iu)^(?:Hình|Lược đồ|Bảng)\s*\d+"
MAP_LABEL = (
    r"(?iu)(?<![\p{L}\p{N}_])(?:BIỂN|DAO|ĐẢO|SÔNG|KÊNH|VỊNH|THÁI BÌNH|ĐẠI TÂY|THU DÂU|THỦ DẦU|PHAN RÍ|PLAYKU|TUY HOA|CHÂU ĐỐC|RẠCH GIA|BẠC LIÊU|CẦN THƠ)(?![\p{L}\p{N}_])"
)
HEADING_HINT = (
    r"(?iu)(?<![\p{L}\p{N}_])(?:CHIẾN|CÁCH|MẠNG|PHONG|TRÀO|NƯỚC|QUỐC|XÃ|HỘI|KINH|TẾ|VĂN|HOÁ|HÓA|CHÍNH|TRỊ|THẾ|GIỚI|VIỆT|NAM|THỜI|KÌ|KỲ|ĐẢNG|KHÁNG|CHỐNG|"
    r"ĐỘC|LẬP|DÂN|TỘC|CÔNG|NHÂN|CHỦ|NGHĨA|GIÁO|DỤC|NGƯỜI|NGUYÊN|THUỶ|THỦY|KIẾN|TƯ|SẢN|ĐẾ|MĨ|MỸ|NHẬT|PHÁP|TRUNG|LIÊN|XÔ)(?![\p{L}\p{N}_])"
)


def is_noise(line: Column) -> Column:
    """Blank lines, page numbers, captions of figures and tables."""
    v = F.trim(line)
    return (v == "") | v.rlike(PAGE_NUMBER) | v.rlike(FIGURE_OR_TABLE)


def is_exercise(line: Column) -> Column:
    v = F.trim(line)
    return v.rlike(EXERCISE_START) | v.rlike(EXERCISE_ASK) | (v.endswith("?") & v.rlike(EXERCISE_CUES))


def is_exercise_snippet(text: Column) -> Column:
    return text.rlike(EXERCISE_BLOCK) | text.rlike(EXERCISE_QUESTION) | text.rlike(QUESTION_HINT)


def remove_exercises(text: Column) -> Column:
    for pattern, by in ((EXERCISE_BLOCK, ""), (EXERCISE_QUESTION, " "), (QUESTION_HINT, " ")):
        text = F.regexp_replace(text, pattern, by)
    return T.squeeze(text)


def is_noisy_heading(line: Column) -> Column:
    """Lines of no words, captions, and short lines that look like labels of a map."""
    v = F.trim(line)
    words = F.regexp_extract_all(v, F.lit(r"([0-9A-Za-zÀ-ỹĐđ]+)"), F.lit(1))
    few, hint = F.size(words) <= 4, v.rlike(HEADING_HINT)
    return (F.size(words) == 0) | v.rlike(FIGURE_OR_TABLE) | (few & (F.forall(words, lambda w: F.length(w) <= 3) | (~hint & (v.rlike(MAP_LABEL) | (T.uppercase_ratio(v) >= 0.8)))))


def is_uppercase_heading(line: Column) -> Column:
    ratio = T.uppercase_ratio(line)
    loud = F.when(line.rlike(r"\p{Nd}"), ratio >= 0.85).otherwise(ratio >= 0.75)
    return (F.size(T.tokens(line)) >= 3) & (F.length(line) <= 120) & ~is_noisy_heading(line) & ~line.rlike(r"[.,;:?!]$") & loud


def heading(line: Column) -> Column:
    """struct(kind, level, number, title) of a heading, or null; the first kind that fits counts."""
    made = lambda kind, level, number, title: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), number.cast("string").alias("number"), title.alias("title"))
    lesson, title = F.regexp_extract(line, LESSON, 1).try_cast("int"), F.trim(F.regexp_extract(line, LESSON, 2))
    section = F.regexp_extract(line, NUMBERED_SECTION, 1).try_cast("int")
    none, short = F.lit(None), F.length(line) <= 140
    return (
        F.when(is_noise(line), None)
        .when(line.rlike(LESSON), made("lesson", 1, lesson, F.concat(F.lit("Bài "), lesson.cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""))))
        .when(line.rlike(LESSON_MARKER), made("lesson_marker", 1, none, F.lit("Bài")))
        .when(line.rlike(MAJOR_SECTION) & short, made("major_section", 2, F.upper(F.regexp_extract(line, MAJOR_SECTION, 1)), line))
        .when(section.between(1, 20) & short & ~F.trim(F.regexp_extract(line, NUMBERED_SECTION, 2)).rlike(r"^[?.]"), made("numbered_section", 3, section, line))
        .when(is_uppercase_heading(line), made("uppercase_heading", 2, none, line))
    )


def page_records(pages: DataFrame, least: int = 80) -> DataFrame:
    """Adds page number, cleaned lines, text and reason (null: the page is kept) to pages (path, book, text)."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\R"), T.squeeze), lambda x: x != "")
    rows = pages.withColumn("number", F.regexp_extract("path", PAGE_FILE, 1).try_cast("int")).withColumn("raw", lines)
    rows = rows.withColumn("whole", F.array_join("raw", " ")).withColumn("lines", F.filter("raw", lambda x: ~is_noise(x))).withColumn("clean", F.array_join("lines", " "))
    lessons = F.size(F.regexp_extract_all("whole", F.lit(r"(?iu)(?<![\p{L}\p{N}_])(Bài\s+\d+)"), F.lit(1)))
    reason = (
        F.when(F.col("number").isNull(), "unparsed_filename").when(F.length("whole") < least, "too_short")
        .when((lessons >= 5) | ((lessons == 0) & F.col("whole").rlike(PUBLICATION)), "publication_or_index_page").when(F.length("clean") < least, "too_short")
    )
    return rows.select("path", "book", F.col("number").alias("page"), "lines", F.col("clean").alias("text"), reason.alias("reason"))


def build_chunks(pages: DataFrame, least: int = 120, most: int = 2200, overlap: int = 200) -> DataFrame:
    """(book, section, piece, title, kind, pages, years, text): kept pages cut at headings, exercises dropped.

    Pages without a heading before a book's first section are chunks by themselves (section
    0); short sections vanish after numbering; long ones are split. Windows run over one
    book's lines.
    """
    from .aliases import split_text

    lines = pages.where("reason IS NULL").select("book", "page", F.posexplode("lines").alias("no", "line"))
    lines = lines.withColumn("h", heading(F.col("line"))).withColumn("e", is_exercise(F.col("line")))
    lines = lines.withColumn("is_h", F.col("h").isNotNull()).withColumn("resume", F.coalesce(F.col("h.kind") != "numbered_section", F.lit(False)))
    lines = lines.withColumn("at", F.struct("page", "no"))
    cut = sections(lines, "book", "at", "is_h", "e", "resume").where("kept")
    headed = F.max("is_h").over(Window.partitionBy("book", "page"))
    cut = cut.withColumn("headed", headed).where("section > 0 OR NOT headed").withColumn("alone", F.when(F.col("section") == 0, F.col("page")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ")
    head = F.min_by(F.col("h"), F.col("at"))
    made = cut.groupBy("book", "section", "alone").agg(remove_exercises(text).alias("text"), F.when(F.col("section") > 0, head).alias("h"), F.array_sort(F.collect_set("page")).alias("pages"))
    made = made.where(F.length("text") >= least)
    out = made.select("book", "section", F.col("h.title").alias("title"), F.coalesce("h.kind", F.lit("page_fallback")).alias("kind"), "pages", F.posexplode(split_text(F.col("text"), most, overlap)).alias("piece", "text"))
    return out.withColumn("years", F.array_sort(T.years(F.col("text"))))


def overlaps(chunks: DataFrame, most: int = 200) -> DataFrame:
    """Adds prev_id, next_id and contextual_text: the end of the section before, unless it reads like an
    exercise, in front of the text; chunks: book, ord, chunk_id, kind, text."""
    w = Window.partitionBy("book").orderBy("ord")
    before, kind = F.lag("text").over(w), F.lag("kind").over(w)
    prefix = T.tail(before, most)
    usable = before.isNotNull() & (F.col("kind") != "page_fallback") & (kind != "page_fallback") & ~is_exercise_snippet(prefix)
    return chunks.select("*", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), F.when(usable, F.concat_ws(" ", prefix, "text")).otherwise(F.col("text")).alias("contextual_text"))
