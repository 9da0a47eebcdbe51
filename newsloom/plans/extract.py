"""Everything read from a page, as one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import all_matches, is_blank, let, replace_matches
from newsloom.functions.page import featured_image, page_images, page_metadata, page_title
from newsloom.functions.urls import resolve_url, url_basename
from newsloom.operators.blocks import main_content


FIELDS = ("success", "title", "content", "origin", "featured_image", "images", "metadata", "error")


def extract_pages(
    pages: DataFrame, keep: tuple[str, ...] = ("url",), fields: tuple[str, ...] = FIELDS, **content_options
) -> DataFrame:
    """``keep`` columns plus the wanted ``fields`` of the page record.

    ``pages`` brings (url, html).  A missing or empty page gives ``success=false``.
    """
    html, url = F.col("html"), F.col("url")
    fetched = ~is_blank(html)
    found = main_content(pages.select(*dict.fromkeys((*keep, "url", "html"))), **content_options)
    makers = {
        "success": lambda: fetched,
        "title": lambda: F.when(fetched, page_title(html, url)).otherwise(""),
        "content": lambda: F.when(fetched, F.col("content")).otherwise(""),
        "origin": lambda: F.col("origin"),
        "featured_image": lambda: F.when(fetched, featured_image(html, url)).otherwise(""),
        "images": lambda: F.when(fetched, page_images(html, url)).otherwise(F.array().cast("array<string>")),
        "metadata": lambda: page_metadata(F.when(fetched, html)),
        "error": lambda: F.when(~fetched, fixed.NO_PAGE_ERROR),
    }
    return found.select(*keep, *[makers[name]().alias(name) for name in fields])


_MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif", "png": "image/png",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "ico": "image/x-icon",
}


def mime_type(file_name: Column) -> Column:
    """Type by file extension; null for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in _MIME.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1)))


def _image_attribute(name: str) -> str:
    """An image tag up to the value of an attribute; the attributes before it are passed one by one, so neither
    ``data-src`` nor a quoted ``"src="`` is taken for ``src``."""
    return (
        r"""(?i)<img(?:\s++(?!NAME[\s=])[^\s=>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+"""
        r"""\s++NAME\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    ).replace("NAME", name)


_SRC, _CLASS = _image_attribute("src"), _image_attribute("class")
_IMAGE_TAG = _SRC + r"[^>]*+>"


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def _attachment(owner: Column, src: Column, position: Column, base: Column) -> Column:
    """The attachment row of an image, or null where its type is not known or its address is none."""

    def named(url: Column) -> Column:
        made_up = F.concat(F.lit("image-"), F.md5(url), F.lit(".jpg"))
        name = let(url_basename(url), lambda n: F.when(F.contains(n, F.lit(".")), n).otherwise(made_up))
        return let(name, lambda file: F.struct(
            F.md5(F.concat_ws("|", owner, position.cast("string"))).alias("attachment_id"),
            position.cast("long").alias("position"),
            url.alias("image_url"),
            file.alias("file_name"),
            mime_type(file).alias("mime_type"),
            F.regexp_replace(file, r"\.[^.]+$", "").alias("post_title"),
            F.lit("inherit").alias("post_status"),
        ))

    row = F.when(~is_blank(src), let(resolve_url(src, base), named))
    return let(row, lambda i: F.when(i["mime_type"].isNotNull() & i["image_url"].rlike(r"^https?://[^/\s?#]+([/?#]\S*)?$"), i))


def image_manifest(posts: DataFrame, post_id: str = "post_id", html: str = "post_content", base: str = "url") -> DataFrame:
    """One row per usable image of a post: address, file, type, title.

    An image whose file name has no extension gets a name from its address.
    The rows are made inside the post's row and laid out at the end.
    """
    owner = F.col(post_id).cast("string")
    images = F.transform(all_matches(html, _SRC, 1), lambda src, k: _attachment(owner, _unquoted(src), k, F.col(base)))
    return posts.select(F.col(post_id).alias("post_parent"), F.inline(F.filter(images, lambda i: i.isNotNull())))


def with_local_images(
    posts: DataFrame, media_url: str, post_id: str = "post_id", html: str = "post_content", base: str = "url"
) -> DataFrame:
    """``posts`` with their images' addresses below ``media_url`` and a class that names the attachment.

    Attachments are those of ``image_manifest``; other images stay as they are.  A local address is the
    attachment's id and file name.
    """
    owner = F.col(post_id).cast("string")

    def rewritten(tag: Column, image: Column, head: Column) -> Column:
        raw = F.regexp_extract(head, _SRC, 1)
        address = F.concat(F.lit(media_url.rstrip("/") + "/"), image["attachment_id"], F.lit("-"), image["file_name"])
        before, after = F.substr(head, F.lit(1), F.length(head) - F.length(raw)), F.substr(tag, F.length(head) + 1)
        mark = F.concat(F.lit(fixed.IMAGE_CLASS), image["attachment_id"])

        def classed(made: Column) -> Column:
            start = F.regexp_extract(made, _CLASS, 0)
            own = F.regexp_extract(made, _CLASS, 1)
            joined = F.concat(
                F.substr(start, F.lit(1), F.length(start) - F.length(own)), F.lit('"'), F.trim(F.concat(_unquoted(own), F.lit(" "), mark)), F.lit('"'),
                F.substr(made, F.length(start) + 1))
            return F.when(start != "", joined).otherwise(F.concat(F.substr(made, F.lit(1), F.lit(4)), F.lit(' class="'), mark, F.lit('"'), F.substr(made, F.lit(5))))

        return let(F.concat(before, F.lit('"'), address, F.lit('"'), after), classed)

    def token(tag: Column, position: Column) -> Column:
        head = F.regexp_extract(tag, _SRC, 0)
        return let(head, lambda h: let(
            _attachment(owner, _unquoted(F.regexp_extract(h, _SRC, 1)), position, F.col(base)),
            lambda image: F.when(image.isNull(), tag).otherwise(rewritten(tag, image, h))))

    has_images = F.contains(F.lower(html), F.lit("<img"))
    return posts.withColumn(html, F.when(has_images, replace_matches(html, _IMAGE_TAG, token)).otherwise(F.col(html)))
