"""URL and HTML functions as Column expressions, over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.text import _c, flat


def host(url: Column | str) -> Column:
    """Lower case, without user, port and a leading www. or m."""
    raw = F.regexp_extract(F.lower(F.trim(_c(url))), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(raw, r"^(www|m)\.", ""), F.lit(""))


def canonical_url(url: Column | str) -> Column:
    """http(s) only; lower-case scheme and host, path with single slashes and one at its end, no query and fragment."""
    u = F.trim(_c(url))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z]+)://", 1))
    name = F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+", "/")
    return F.when(scheme.isin("http", "https") & (name != ""), F.concat(scheme, F.lit("://"), name, F.regexp_replace(path, "/+$", ""), F.lit("/")))


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """A link as found on the page base."""
    h = F.trim(_c(href))
    root = F.regexp_extract(_c(base), r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(_c(base), r"^(https?://[^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(h.rlike(r"(?i)^https?://"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(_c(base), r"^(https?:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.rlike(r"^(#|mailto:|javascript:|tel:)") | (h == ""), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, F.lit("/"), h))
    )


def same_site(url: Column | str, other: Column | str) -> Column:
    return host(url).eqNullSafe(host(other)) & host(url).isNotNull()


def journal_base(url: Column | str) -> Column:
    """A journal's address out of that of any of its issue, article or archive pages."""
    bare = F.regexp_replace(_c(url), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)/(issue|article|bai-viet|search|about|login|archive|archives)(/.*)?$", ""), "/+$", "")


def archive_url(url: Column | str) -> Column:
    return F.concat(journal_base(url), F.lit("/issue/archive"))


def links(html: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(html), F.lit(r'(?i)href\s*=\s*"([^"]*)"'), F.lit(1)))


def link_kind(url: Column | str) -> Column:
    u = F.lower(_c(url))
    return (
        F.when(u.rlike(r"/issue/archive"), "archive")
        .when(u.rlike(r"/issue/view/"), "issue")
        .when(u.rlike(r"/(article/view|bai-viet)/"), "article")
        .when(u.rlike(r"[?&/](page|trang)[=/]?\d+"), "page")
        .when(u.rlike(r"/[a-z0-9-]+/\d+/?$"), "detail")
        .otherwise("other")
    )


def meta(html: Column | str, name: str) -> Column:
    """content of a meta element, attributes in either order."""
    one = F.regexp_extract(_c(html), rf'(?i)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1)
    two = F.regexp_extract(_c(html), rf'(?i)<meta[^>]*content="([^"]*)"[^>]*name="{name}"', 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")))


def page_title(html: Column | str) -> Column:
    return F.nullif(flat(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_language(html: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(html), r'(?i)<html[^>]*\blang="([a-zA-Z]{2})', 1)), F.lit(""))


def plain_text(html: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_c(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    return flat(F.replace(F.replace(F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))


def page_abstract(html: Column | str) -> Column:
    """The element of class abstract, else what follows a heading of that name; without the word itself."""
    block = F.regexp_extract(_c(html), r'(?is)<(?:div|section)[^>]*class="[^"]*abstract[^"]*"[^>]*>(.*?)</(?:div|section)>', 1)
    after = F.regexp_extract(_c(html), r"(?is)<h\d[^>]*>\s*(?:tóm tắt|abstract)\s*</h\d>\s*<p[^>]*>(.*?)</p>", 1)
    return F.nullif(F.regexp_replace(plain_text(F.when(block != "", block).otherwise(after)), r"(?i)^(tóm tắt|abstract)\s*:?\s*", ""), F.lit(""))


def question_page(html: Column | str) -> Column:
    """struct(question, doctor, answer): of a question-and-answer page; contact and closing paragraphs dropped, the asker's name never read."""
    grab = lambda cls: plain_text(F.regexp_extract(_c(html), rf'(?is)<div[^>]*class="{cls}"[^>]*>(.*?)</div>', 1))
    body = F.regexp_extract(_c(html), r'(?is)<div[^>]*class="answer"[^>]*>(.*?)</div>', 1)
    paragraphs = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: plain_text(p))
    kept = F.filter(paragraphs, lambda p: (p != "") & ~F.lower(p).rlike(r"(hotline|tổng đài|liên hệ|website)|^(cảm ơn bạn|thân mến|trân trọng)"))
    return F.struct(grab("question").alias("question"), grab("doctor").alias("doctor"), F.array_join(kept, "\n\n").alias("answer"))


def allowed_by_robots(url: Column | str, disallowed: list[str]) -> Column:
    path = F.concat(F.lit("/"), F.regexp_extract(_c(url), r"^https?://[^/?#]+/?([^#]*)", 1))
    return ~F.exists(F.array(*(F.lit(d) for d in disallowed)), lambda d: (d != "") & path.startswith(d)) if disallowed else F.lit(True)
