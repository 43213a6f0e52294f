"""URLs and search results as columns: domains, kinds of source, the discovery gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions.text import contains_any


def netloc(url: Column) -> Column:
    """What stands between ``//`` and the path, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def domain_of(url: Column) -> Column:
    """Host without user, port and ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":.*$", ""), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def joined(base: Column, link: Column) -> Column:
    """``link`` as an absolute URL, seen from a page at ``base``; dots in its path are followed."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"^(.*/)[^/]*$", 1)
    whole = F.when(link == "", base).when(link.startswith("?"), F.concat(origin, path_of(base), link)).when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
    path = F.regexp_extract(link, "^([^?#]*)", 1)
    rest = F.substr(link, F.length(path) + 1)
    steps = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path)), "/")
    last = F.element_at(steps, -1)
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    follow = lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    done = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array(F.lit("")), follow)
    plain = F.concat(F.array_join(done, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    within = F.concat(origin, F.when(F.contains(path, F.lit(".")), plain).otherwise(F.array_join(steps, "/")), rest)
    absolute = link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(absolute, link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).otherwise(F.coalesce(whole, within))


def under_domain(domain: Column, domains) -> Column:
    """Whether a domain is one of ``domains`` or below one."""
    found = domain.isin(*domains)
    for d in domains:
        found = found | domain.endswith(f".{d}")
    return found


def host_matches(host: Column, hints) -> Column:
    """Equal to a hint, below it, or with it as a whole label; never as a mere substring."""
    return under_domain(host, hints) | F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, hints)))


def source_kind(url: Column, company_domain: Column | None = None) -> Column:
    """Kind of source by the first rule that holds."""
    host = domain_of(url)
    path = F.lower(path_of(url))
    path = F.when(path == "", "/").otherwise(path)
    kind = (
        F.when(host_matches(host, V.PROFILE_HOSTS), "perfil_publico")
        .when(host_matches(host, V.DIRECTORY_HOSTS), "diretorio_startup")
        .when(host_matches(host, V.NEWS_HOSTS), "noticia")
        .when(contains_any(F.concat(host, path), V.CAREER_HINTS), "pagina_carreiras")
        .when(host.startswith("docs.") | contains_any(path, V.DOCS_HINTS), "documentacao")
        .when(host.startswith("blog.") | contains_any(path, V.BLOG_HINTS), "blog_tecnico")
    )
    if company_domain is not None:
        own = F.regexp_replace(F.lower(company_domain), r"^www\.", "")
        kind = kind.when((own != "") & (host != own) & ~host.endswith(F.concat(F.lit("."), own)), "outro")
    return kind.otherwise("site_oficial")


def content_path(url: Column) -> Column:
    """Whether a URL has the shape of an article, a vacancy or a post."""
    path = F.lower(path_of(url))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    dated = F.exists(segments, lambda s: s.rlike("^(19|20)[0-9]{2}$"))
    sentence = F.exists(segments, lambda s: F.size(F.split(s, "-")) >= V.SLUG_WORDS)
    return contains_any(path, V.CONTENT_PATHS) | (F.size(segments) > V.PATH_SEGMENTS) | dated | sentence


def _padded(title: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.lower(title)), F.lit(" "))


def headline_title(title: Column) -> Column:
    return F.trim(title).rlike(r"^[0-9]{1,3}\s+\S") | contains_any(_padded(title), V.HEADLINE_MARKS)


def subject_title(title: Column) -> Column:
    """A phrase with a linking preposition and no capital after its first word."""
    words = F.split(F.trim(title), r"\s+")
    capital = F.exists(F.slice(words, 2, F.size(words)), lambda w: w.rlike(r"^\p{Lu}"))
    return contains_any(_padded(title), V.SUBJECT_PREPOSITIONS) & ~capital


def rejection(url: Column, title: Column) -> Column:
    """The first rule of the discovery gate that turns a candidate away; null for what is let in."""
    title = F.coalesce(title, F.lit(""))
    return (
        F.when(under_domain(domain_of(url), V.AGGREGATORS), "agregador")
        .when(content_path(url), "caminho_de_conteudo")
        .when(headline_title(title), "titulo_de_manchete")
        .when(subject_title(title), "titulo_de_assunto")
    )


def likely_name(url: Column, title: Column) -> Column:
    """Working name: the title up to its first separator, or the domain's first label."""
    bare = F.trim(F.coalesce(title, F.lit("")))
    cut = bare
    for mark in reversed(V.NAME_SEPARATORS):
        cut = F.when(bare.contains(mark), F.trim(F.substring_index(bare, mark, 1))).otherwise(cut)
    label = F.substring_index(domain_of(url), ".", 1)
    return F.when(F.length(cut) >= 2, F.substring(cut, 1, V.NAME_CHARS)).otherwise(F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, F.length(label))))
