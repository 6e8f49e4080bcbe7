"""Column functions over text: tags, titles, pages, names, URLs. No Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The platforms and what their result URLs contain.
PLATFORM_DOMAINS = {"jobindex": "jobindex.dk", "indeed": "indeed.", "linkedin": "linkedin.com/jobs", "thehub": "thehub.io"}
# Phrases of archived results.
ARCHIVED = ("archive", "arkiv", "expired", "udløbet", "not active")
# Search pages and their parameter names.
SEARCH_PAGES = {"jobindex": ("https://www.jobindex.dk/jobsoeg", "q", "where"), "linkedin": ("https://www.linkedin.com/jobs/search", "keywords", "location"), "thehub": ("https://thehub.io/jobs", "q", "city")}
# Entities in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))

# Characters that a URL's parts keep as they are, and those that no host may have.
KEPT_IN_PATHS = r"!$%&'()*+,./0-9:;=@A-Z\[\\\]_a-z|~-"
KEPT_IN_QUERIES = r"!$%&()*+,./0-9:;=?@A-Z\[\\\]^_`a-z{|}~-"
KEPT_IN_FRAGMENTS = r"!#$%&'()*+,./0-9:;=?@A-Z\[\\\]^_a-z{|}~-"
KEPT_IN_USERS = r"!$%&'()*+,.0-9:A-Z_a-z~-"
FORBIDDEN_IN_HOSTS = r"^(?!\[[0-9a-f:.]+\]$).*[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
IPV4_PART = r"^(0x[0-9a-f]*|0[0-7]*|[1-9][0-9]*)$"

# What a form's encoding gives otherwise than a URL component's.
PLAIN_IN_COMPONENTS = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


# What Unicode calls white space, and what a browser's trim takes off.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BROWSER_WHITE = WHITE.replace("\x85", "") + "\ufeff"


def stripped(c: Column) -> Column:
    """Without white space at both ends, as a browser trims: U+FEFF goes, U+0085 stays."""
    return F.btrim(c, F.lit(BROWSER_WHITE))


def trimmed(c: Column) -> Column:
    """Without what Unicode calls white space at both ends: U+0085 goes, U+FEFF stays. Tags, titles, ages and the company of
    a saved row are trimmed like this."""
    return F.btrim(c, F.lit(WHITE))


def json_value(c: Column) -> Column:
    """A variant array with the JSON value of a text as its one element; null if the text isn't one JSON value (two
    values, what follows a value, an object that repeats a key)."""
    one = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))  # in a list, so that nothing may follow the value
    return F.when(F.size(F.try_variant_get(one, "$", "array<variant>")) == 1, one)


def string_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; null for values of other types."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def blank_to_null(c: Column) -> Column:
    """Null where nothing but white space is left; else the value as it is."""
    return F.when(stripped(c) != "", c)


def lower_order(c: Column, locale: str = "UNICODE") -> Column:
    """The sort key of a text: trimmed, in lower case, in the order of letters (accents after their base; of a locale such
    as `da`, in that language's order), null if blank."""
    return F.collate(F.nullif(F.lower(stripped(c)), F.lit("")), locale)


def parse_tags(c: Column) -> Column:
    """A JSON array of strings only, or parts between , ; | line ends and tabs; quotes off, lower case, blanks out.

    The types of the parsed values decide, not how the text looks: what isn't strict JSON (raw line ends in a string,
    unknown escapes) or holds anything but strings is split."""
    t = trimmed(text(c))
    values = F.when(t.startswith("["), F.try_variant_get(json_value(t), "$[0]", "array<variant>"))
    listed = F.when(F.forall(values, lambda v: F.schema_of_variant(v) == "STRING"), F.transform(values, lambda v: F.lower(trimmed(F.try_variant_get(v, "$", "string")))))
    parts = F.transform(F.split(t, r"[,;|\n\t]"), lambda x: F.lower(F.btrim(F.btrim(trimmed(x), F.lit('"')), F.lit("'"))))
    return F.filter(F.coalesce(listed, parts), lambda x: x != "")


def split_title(c: Column) -> tuple[Column, Column]:
    """(title, company) of "title - company"; no company without the separator."""
    at = F.instr(c, " - ")
    return F.when(at > 0, trimmed(F.substring(c, F.lit(1), at - 1))).otherwise(trimmed(c)), F.when(at > 0, trimmed(F.substring(c, at + 3, F.length(c)))).otherwise("")


def html_to_text(c: Column) -> Column:
    """Tags out, spaces folded, entities replaced once in their fixed order, spaces folded again."""
    out = F.regexp_replace(F.regexp_replace(text(c), r"<[^>]*(>|$)", ""), ">", "")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def page_text(c: Column, limit: int = 12_000) -> Column:
    """The text from the body tag on (the whole page without one), its first `limit` characters."""
    start = F.greatest(F.instr(F.lower(text(c)), "<body"), F.lit(1))
    return F.substring(html_to_text(F.substring(text(c), start, F.length(text(c)))), 1, limit)


def _named(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), the value worked out once a row however often made reads it. Without it a step
    that later steps read several times is written out, and worked out, once for each way to it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _urls(c: Column, made: Callable[[Column], Column]) -> Column:
    """made(the parts of an absolute URL as a browser reads them): scheme, user, host, port, path, query, fragment; empty
    strings where it isn't one.

    Line ends and tabs don't count, \\ is / for web schemes, and whatever comes before the last @ is user info."""
    web = r"(?is)^(https?|wss?|ftp):[/\\\\]*([^/\\\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    other = r"(?is)^([a-z][a-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

    def cut(t: Column, is_web: bool) -> Column:
        part = lambda n: F.regexp_extract(t, web if is_web else other, n)
        return F.struct(F.lit(is_web).alias("web"), F.lower(part(1)).alias("scheme"), part(2).alias("at"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment"), F.regexp_replace(part(2), "^.*@", "").alias("place"))

    def parts(u: Column) -> Column:
        name = F.regexp_replace(u["place"], r":\d*$", "")
        return F.struct(
            u["scheme"].alias("scheme"), F.regexp_extract(u["at"], "^(.*)@", 1).alias("user"), F.when(u["web"], web_host(name)).otherwise(F.lower(name)).alias("host"),
            F.regexp_replace(F.regexp_extract(u["place"], r":(\d*)$", 1), "^0+(?=.)", "").alias("port"), F.translate(u["path"], "\\", "/").alias("path"), u["query"].alias("query"), u["fragment"].alias("fragment"),
        )

    whole = _named(F.translate(stripped(c), "\t\n\r", ""), lambda t: F.when(t.rlike(web), cut(t, True)).otherwise(cut(t, False)))
    return _named(_named(whole, parts), made)


def web_host(name: Column) -> Column:
    """A host as browsers write it: percent codes read, letters beyond ASCII in their xn-- form, lower case, numbers as an
    IPv4 address. What can't be a host comes back with a character that no host may have."""
    decoded = lambda n: F.when(n.contains("%"), F.coalesce(F.try_url_decode(F.replace(n, F.lit("+"), F.lit("%2B"))), F.lit("%"))).otherwise(n)
    ascii_form = lambda n: F.coalesce(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), n)), F.lit("%"))
    folded = F.lower(F.translate(_named(name, decoded), "\u3002\uff0e\uff61\u00ad", "..."))
    made = _named(folded, lambda n: F.when(n.rlike(r"[^\x00-\x7F]"), ascii_form(n)).otherwise(n))
    return _named(made, lambda n: F.when(F.regexp_replace(n, r"\.$", "").rlike(r"(^|\.)(\d+|0x[0-9a-f]*)$"), F.coalesce(_ipv4(n), F.lit("%"))).otherwise(n))


def _ipv4(host: Column) -> Column:
    """The address that one to four decimal, octal (0...) or hexadecimal (0x...) numbers name; null for anything else."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    digits = lambda x: F.when(x.startswith("0x"), F.substring(x, F.lit(3), F.length(x))).otherwise(x)
    base = lambda x, of: F.conv(digits(x), of, 10).cast("decimal(20,0)")
    number = lambda x: F.when(~x.rlike(IPV4_PART) | (F.length(x) > 18), None).when(x == "0x", 0).when(x.startswith("0x"), base(x, 16)).when(x.rlike("^0[0-7]+$"), base(x, 8)).otherwise(base(x, 10))

    def written(n: Column) -> Column:
        first, last = F.slice(n, F.lit(1), F.size(n) - 1), F.element_at(n, -1)
        room = F.get(F.array(*[F.lit(1 << k) for k in (32, 24, 16, 8)]), F.size(n) - 1)
        fine = (F.size(n) <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(first, lambda x: x <= 255) & (last < room)
        high = F.aggregate(first, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long")) * room
        return F.when(fine, _named(high + last.cast("long"), lambda whole: F.concat_ws(".", *[(F.shiftright(whole, k) % 256).cast("string") for k in (24, 16, 8, 0)])))

    return _named(F.transform(parts, lambda x: number(x).cast("decimal(20,0)")), written)


def _encoded(c: Column, keep: str) -> Column:
    """c with every character outside `keep` as the percent codes of its UTF-8 bytes."""
    each = lambda x: F.when(x.rlike(f"^[{keep}]$"), x).otherwise(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    return _named(c, lambda t: F.when(t.rlike(rf"\A[{keep}]*\z"), t).otherwise(F.array_join(F.transform(F.split(t, ""), each), "")))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    one, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))

    def resolved(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.rlike(two), up(acc)).when(x.rlike(one), acc).otherwise(F.concat(acc, F.array(x))))
        closed = F.when(F.element_at(parts, -1).rlike(f"{one}|{two}"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, closed), "/"))

    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), _named(parts, resolved)).otherwise(path)


def host(c: Column) -> Column:
    """The host of an absolute URL in lower case (empty if it names none); null for anything else."""
    return _urls(c, lambda u: F.when((u["scheme"] != "") & ~u["host"].rlike(FORBIDDEN_IN_HOSTS), u["host"]))


def source_of_url(c: Column) -> Column:
    return F.regexp_replace(host(c), r"^www\.", "")


def capture_url(c: Column) -> Column:
    """The trimmed URL as a browser writes it if it is absolute http(s), else null: host in lower case, at least the
    path /, no default port, dots in the path resolved, spaces and letters beyond ASCII in percent codes, user info kept.
    Hosts are written as web_host says."""

    def built(u: Column) -> Column:
        port = F.when(((u["scheme"] == "http") & (u["port"] == "80")) | ((u["scheme"] == "https") & (u["port"] == "443")), "").otherwise(F.concat(F.lit(":"), u["port"]))
        path = F.when(u["path"] == "", "/").otherwise(_encoded(_without_dots(u["path"]), KEPT_IN_PATHS))
        user = F.when(u["user"] != "", F.concat(_encoded(u["user"], KEPT_IN_USERS), F.lit("@"))).otherwise("")
        query, fragment = (F.when(F.length(u[k]) > 1, _encoded(u[k], keep)).otherwise(u[k]) for k, keep in (("query", KEPT_IN_QUERIES), ("fragment", KEPT_IN_FRAGMENTS)))
        sound = (u["host"] != "") & ~u["host"].rlike(FORBIDDEN_IN_HOSTS) & ((u["port"] == "") | (u["port"].try_cast("int") <= 65535))
        return F.when(u["scheme"].isin("http", "https") & sound, F.concat(u["scheme"], F.lit("://"), user, u["host"], F.when(u["port"] == "", "").otherwise(port), path, query, fragment))

    return _urls(c, built)


def job_key(c: Column) -> Column:
    return F.try_url_decode(F.try_parse_url(c, F.lit("QUERY"), F.lit("jk")))


def form_encoded(c: Column) -> Column:
    return F.url_encode(c)


def component_encoded(c: Column) -> Column:
    """Percent-encoded, but for letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(c)
    for code, plain in PLAIN_IN_COMPONENTS:
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def archived(platform: Column, url: Column, title: Column, description: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", text(url), text(title), text(description)))
    return (platform == "jobindex") & hay.rlike("|".join(ARCHIVED))


def kept(platform: Column, url: Column, title: Column, description: Column) -> Column:
    """Whether a result counts: it has a link, on its platform's domain (unknown platforms keep any), and isn't archived."""
    domain = F.create_map(*[F.lit(x) for kv in PLATFORM_DOMAINS.items() for x in kv])[platform]
    return (text(url) != "") & (domain.isNull() | F.contains(F.lower(text(url)), domain)) & ~archived(platform, url, title, description)


def search_url(platform: Column, keywords: Column, location: Column, region: Column) -> Column:
    """The platform's search page for joined keywords; unknown platforms give null."""
    query, loc = form_encoded(F.array_join(keywords, " ")), text(location)

    def made(base: Column, q: str, where: str) -> Column:
        return F.concat(base, F.lit(f"?{q}="), query, F.when(loc != "", F.concat(F.lit(f"&{where}="), form_encoded(loc))).otherwise(""))

    area = F.coalesce(region, F.lit("dk"))
    indeed = F.concat(F.lit("https://"), F.when(area == "com", "www").otherwise(area), F.lit(".indeed.com/jobs"))
    out = F.when(platform == "indeed", made(indeed, "q", "l"))
    for name, (base, q, where) in SEARCH_PAGES.items():
        out = out.when(platform == name, made(F.lit(base), q, where))
    return out


def provider_query(platform: Column, keywords: Column, location: Column) -> Column:
    domain = F.create_map(*[F.lit(x) for kv in PLATFORM_DOMAINS.items() for x in kv])[platform]
    return F.concat_ws(" ", F.array_join(keywords, " "), F.nullif(trimmed(text(location)), F.lit("")), F.when(domain.isNotNull(), F.concat(F.lit("site:"), domain)))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def base_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, "([^/]+)/*$", 1), F.lit("")), c)


def address(street: Column, postal: Column, city: Column) -> Column:
    town = F.nullif(F.concat_ws(" ", blank_to_null(postal), blank_to_null(city)), F.lit(""))
    return F.concat_ws(", ", blank_to_null(street), town)
