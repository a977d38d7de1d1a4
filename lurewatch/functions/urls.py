"""URL parts and flags as column expressions.

Python's rules are kept where Spark's `parse_url` differs: the whole URL is
percent-decoded before it is split, hosts may hold underscores, and user, port
and brackets are dropped from the host.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from lurewatch.functions.arrays import derive, let, string_array
from lurewatch.rules.fixed import FLAGGED_SHORTENERS, PARAM_SCHEMES

# URL, host and display patterns.
LEADING_CONTROLS = "".join(map(chr, range(0x21)))
TEXT_URL = r"(?U)https?://[^\s\x1c-\x1f<>\"']+"
TRAILING_PUNCTUATION = r"[.,;:!?)]+\z"
SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
IP_HOST = r"(?U)\A(\d{1,3}\.){3}\d{1,3}\z|\A\[?[0-9a-fA-F:]+\]?\z"
SHOWN_URL = r"(?U)https?://([^/\s\x1c-\x1f]+)"
SHOWN_HOST = r"(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,})"
#: Signs that a host must not hold, also not after compatibility normalization.
NOT_IN_HOST = "/?#@:"


def _bracket_host() -> str:
    """What may stand in brackets: an IPv6 address, with an optional zone, or a later kind."""
    group, part = "[0-9a-fA-F]{1,4}", "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    dotted = rf"{part}(\.{part}){{3}}"
    forms = [rf"({group}:){{7}}{group}", rf"({group}:){{6}}{dotted}"]
    for before in range(8):
        # a double colon stands for one group at least
        after = 7 - before
        left = rf"{group}(:{group}){{{before - 1}}}" if before else ""
        right = [rf"({group}(:{group}){{0,{after - 1}}})?"] if after else [""]
        if after >= 2:
            right.append(rf"({group}:){{0,{after - 2}}}{dotted}")
        forms.append(rf"{left}::({'|'.join(right)})")
    return rf"(?s)\A(({'|'.join(forms)})(%[^%]+)?|v[0-9a-fA-F]+\..+)\z"


def _unfolding_signs() -> str:
    """A class of the characters whose compatibility form holds one of NOT_IN_HOST."""
    codes = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    found = [c for c in codes if any(s in unicodedata.normalize("NFKC", chr(c)) for s in NOT_IN_HOST)]
    return "[" + "".join(rf"\x{{{c:x}}}" for c in found) + "]"


BRACKET_HOST = _bracket_host()
UNFOLDING = _unfolding_signs()


def percent_decode(url: Column) -> Column:
    """Decode %XX as UTF-8; `+` and stray `%` stay as they are."""
    guarded = F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25")
    guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
    return F.when(url.contains("%"), F.try_url_decode(guarded)).otherwise(url)


def without_controls(url: Column) -> Column:
    """Without leading control characters and blanks, and without line breaks and tabs."""
    return F.translate(F.ltrim(url, F.lit(LEADING_CONTROLS)), "\t\r\n", "")


def urls_in_text(text: Column) -> Column:
    """URLs written out in a text, without closing punctuation, in order."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(TEXT_URL), F.lit(0)),
        lambda u: F.regexp_replace(u, TRAILING_PUNCTUATION, ""),
    )
    return F.when(text.contains("://"), found).otherwise(string_array([]))


def display_domain(shown: Column) -> Column:
    """The domain a link text names, lower case, or an empty string."""
    in_url = F.when(shown.contains("://"), F.regexp_extract(shown, SHOWN_URL, 1)).otherwise("")
    bare = F.when(shown.contains("."), F.regexp_extract(shown, SHOWN_HOST, 0)).otherwise("")
    return let(F.lower(in_url), lambda named: F.when(named != "", named).otherwise(F.lower(bare)))


def uses_https(url: Column) -> Column:
    return F.lower(F.substring(without_controls(url), 1, 6)) == "https:"


def is_ip_host(domain: Column) -> Column:
    return domain.rlike(IP_HOST)


def is_punycode(domain: Column) -> Column:
    return domain.startswith("xn--") | domain.contains(".xn--")


def is_flagged_shortener(domain: Column) -> Column:
    return F.lower(domain).isin(FLAGGED_SHORTENERS)


def _is_refused(authority: Column) -> Column:
    """Whether Python refuses a URL for its authority: brackets, or signs that normalization brings out."""
    opens, closes = authority.contains("["), authority.contains("]")
    bracketed = F.regexp_extract(authority, r"\[([^\]]*)", 1)
    return (opens != closes) | (opens & closes & ~bracketed.rlike(BRACKET_HOST)) | authority.rlike(UNFOLDING)


def _authority(url: Column) -> Column:
    rest = F.regexp_replace(url, SCHEME, "")
    return F.when(rest.startswith("//"), F.regexp_extract(rest, r"\A//([^/?#]*)", 1)).otherwise("")


def link_facts(links: Column) -> Column:
    """Parts and flags for an array of `struct<visible_text, href, from_text>`."""
    # plain string functions where they do: patterns cost ten times as much
    links = derive(
        links,
        lambda l: {
            "_url": without_controls(percent_decode(l["href"])),
        },
    )
    links = derive(links, lambda l: {"scheme": F.lower(F.regexp_extract(l["_url"], SCHEME, 1))})
    links = derive(
        links,
        lambda l: {
            "_rest": F.when(
                l["scheme"] != "", F.substr(l["_url"], F.length(l["scheme"]) + 2)
            ).otherwise(l["_url"]),
        },
    )
    links = derive(
        links,
        lambda l: {
            "_has_authority": l["_rest"].startswith("//"),
            "_authority": F.when(
                l["_rest"].startswith("//"), F.regexp_extract(l["_rest"], r"\A//([^/?#]*)", 1)
            ).otherwise(""),
        },
    )
    links = derive(
        links,
        lambda l: {
            "_hostport": F.substring_index(l["_authority"], "@", -1),
            "_tail": F.substring_index(
                F.when(
                    l["_has_authority"], F.substr(l["_rest"], F.length(l["_authority"]) + 3)
                ).otherwise(l["_rest"]),
                "#",
                1,
            ),
        },
    )
    links = derive(
        links,
        lambda l: {
            "_host": F.when(
                l["_hostport"].contains("["),
                F.regexp_extract(l["_hostport"], r"\[([^\]]*)", 1),
            ).otherwise(F.substring_index(l["_hostport"], ":", 1)),
            "_path": F.substring_index(l["_tail"], "?", 1),
        },
    )
    links = derive(
        links,
        lambda l: {
            # the zone of an IPv6 host, after %, keeps its case
            "domain": F.when(
                l["_host"].contains("%"),
                F.concat(
                    F.lower(F.substring_index(l["_host"], "%", 1)),
                    F.regexp_extract(l["_host"], r"(?s)(%.*)\z", 1),
                ),
            ).otherwise(F.lower(l["_host"])),
            "path": F.when(
                l["_path"].contains(";") & l["scheme"].isin(PARAM_SCHEMES),
                F.regexp_replace(l["_path"], r";[^/]*\z", ""),
            ).otherwise(l["_path"]),
            "query": F.substr(l["_tail"], F.length(l["_path"]) + 2),
        },
    )

    def facts(l: Column) -> Column:
        # such a URL cannot be read; Python raises an error for it. It reads the URL as it is written, too
        changed = l["href"].contains("%")
        written = _authority(without_controls(l["href"]))
        return F.struct(
            l["visible_text"].alias("visible_text"),
            l["href"].alias("href"),
            l["scheme"].alias("scheme"),
            l["domain"].alias("domain"),
            l["path"].alias("path"),
            l["query"].alias("query"),
            is_ip_host(l["domain"]).alias("is_ip_based"),
            is_flagged_shortener(l["domain"]).alias("is_shortened"),
            is_punycode(l["domain"]).alias("is_punycode"),
            uses_https(l["href"]).alias("uses_https"),
            F.when(l["from_text"], l["domain"])
            .otherwise(display_domain(l["visible_text"]))
            .alias("display_domain"),
            l["domain"].alias("target_domain"),
            (_is_refused(l["_authority"]) | (changed & _is_refused(written))).alias("is_malformed"),
        )

    return F.transform(links, facts)


def base64_url_id(url: Column) -> Column:
    """URL-safe base64 of the UTF-8 bytes, without padding or line breaks."""
    plain = F.translate(F.base64(F.encode(url, "UTF-8")), "+/\r\n", "-_")
    return F.rtrim(plain, F.lit("="))
