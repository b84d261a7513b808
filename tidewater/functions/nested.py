"""Nested values that travel as JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEED_SCHEMA = "array<struct<item:string,is_in_network:boolean>>"
SUPERPOSTER_SCHEMA = "array<struct<author_did:string,count:bigint>>"


def feed_items(c: Column, schema: str = FEED_SCHEMA) -> Column:
    """A feed's items; a feed encoded twice is decoded once more."""
    again = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]
    return F.coalesce(F.from_json(c, schema), F.from_json(again, schema))


def defensive(c: Column, schema: str = FEED_SCHEMA) -> Column:
    """First that parses: the text, the first array in it, the text unescaped, the array in that."""
    first_array = lambda x: F.regexp_extract(x, r"\[.*?\](?=[^\]]*$|\[)", 0)
    plain = F.regexp_replace(F.regexp_replace(c, r'\\"', '"'), r'^"|"$', "")
    return F.coalesce(*[F.from_json(x, schema) for x in (c, first_array(c), plain, first_array(plain))])


def map_string_to_json(c: Column) -> Column:
    """{author_did=x, count=1} becomes {"author_did":"x","count":"1"}."""
    return F.regexp_replace(F.regexp_replace(c, r"(\w+)=", '"$1":'), r':([^",}\]\s][^,}\]]*)', ':"$1"')


def packed(*columns: str | Column) -> Column:
    """A row's fields as JSON, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def feed_statistics(items: Column) -> Column:
    """Length, number and share of in-network items of a feed, as JSON."""
    own = F.size(F.filter(items, lambda i: i["is_in_network"]))
    share = F.when(F.size(items) > 0, F.round(own / F.size(items), 3))
    return F.to_json(F.struct(share.alias("prop_in_network"), own.alias("total_in_network"), F.size(items).alias("feed_length")), {"ignoreNullFields": "false"})


def engaged_uri(record_type: Column, uri: Column, subject: Column, reply: Column) -> Column:
    """What a record engages with: a reply's parent, a post itself, else the record's subject."""
    return F.when(record_type == "reply", F.get_json_object(reply, "$.parent.uri")).when(record_type == "post", uri).otherwise(F.get_json_object(subject, "$.uri"))


#: Types of facet features and their names (fixed values).
FEATURES = {"app.bsky.richtext.facet#tag": "tag", "app.bsky.richtext.facet.tag": "tag", "app.bsky.richtext.facet#link": "link", "app.bsky.richtext.facet.link": "link", "app.bsky.richtext.facet#mention": "mention", "app.bsky.richtext.facet.mention": "mention"}
LIST_SEPARATOR = ";"
FEATURE_SCHEMA = "struct<py_type:string,tag:string,uri:string,did:string>"
EMBED_SCHEMA = """struct<py_type:string,images:array<struct<alt:string>>,record:struct<uri:string,cid:string>,external:struct<uri:string,title:string,description:string>,
 media:struct<py_type:string,images:array<struct<alt:string>>>>"""


def facets(c: Column) -> Column:
    """Facets (array of struct kind, value) as kind:value strings, comma-joined."""
    return F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["value"])), ",")


def typed_facets(features: Column, separator: str = LIST_SEPARATOR) -> Column:
    """Features (array of FEATURE_SCHEMA) as tag:, link: and mention: strings; an unknown type fails the job."""
    names = F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair])

    def one(f: Column) -> Column:
        known = F.coalesce(F.element_at(names, f["py_type"]), F.element_at(names, F.lower(f["py_type"])))
        kind = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown feature type: "), F.coalesce(f["py_type"], F.lit("none")))).cast("string"))
        value = F.when(kind == "tag", f["tag"]).when(kind == "link", f["uri"]).otherwise(f["did"])
        return F.concat(kind, F.lit(":"), F.coalesce(value, F.lit("")))

    return F.array_join(F.transform(features, one), separator)


def reply_refs(reply: Column) -> list[Column]:
    """reply_parent and reply_root, the addresses in a reply (JSON); null where there is none."""
    return [F.get_json_object(reply, f"$.{k}.uri").alias(f"reply_{k}") for k in ("parent", "root")]


def flat_embed(embed: Column) -> Column:
    """What an embed (JSON) holds, flat: images by their alternative texts, a record, an external page."""
    e = F.from_json(embed, EMBED_SCHEMA)
    kind = F.coalesce(e["py_type"], F.lit(""))
    both = kind == "app.bsky.embed.recordWithMedia"
    image, record, external = (kind == "app.bsky.embed.images") | both, (kind == "app.bsky.embed.record") | both, kind == "app.bsky.embed.external"
    images = F.when(both, e["media"]["images"]).otherwise(e["images"])
    return F.struct(
        image.alias("has_image"),
        F.when(image, F.array_join(F.transform(F.coalesce(images, F.array().cast("array<struct<alt:string>>")), lambda i: F.coalesce(i["alt"], F.lit(""))), LIST_SEPARATOR)).alias("image_alt_text"),
        record.alias("has_embedded_record"),
        F.when(record, F.to_json(e["record"])).alias("embedded_record"),
        external.alias("has_external"),
        F.when(external, F.to_json(e["external"])).alias("external"),
    )
