"""Query understanding: intent, keywords, complexity; result types and relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .text import index_tokens, let

# Signal words and host lists of the relevance rules.
KEYWORD_STOP = ("a an the is are was were be been being have has had do does did will would could should may might must "
                "shall can need dare ought used to of in for on with at by from as into through during before after above "
                "below between under again further then once and but or nor so yet both either neither not only own same "
                "than too very just also now here there when where why how all each every few more most other some such no "
                "any i me my we our you your it").split()
DEFINITIONAL = ("what is", "what are", "define", "definition", "meaning", "means", "explain", "description", "overview",
                "introduction", "basics")
TUTORIAL = ("how to", "tutorial", "guide", "step by step", "learn", "example", "getting started", "beginner",
            "introduction to", "walkthrough")
COMMERCIAL = ("buy", "price", "cost", "shop", "order", "purchase", "deal", "discount", "cheap", "affordable", "best", "top",
              "review", "compare", "vs", "service", "services", "company", "companies", "provider", "vendor", "hire", "hiring",
              "near me", "in india", "in delhi", "in mumbai", "custom", "printing", "manufacturer", "supplier", "wholesale")
COMPARISON = ("vs", "versus", "compare", "comparison", "better", "best")
NEWS = ("news", "latest", "recent", "today", "update")
DICTIONARY_HOSTS = ("dictionary.com", "merriam-webster.com", "cambridge.org", "oxford.com", "oxfordlearnersdictionaries.com",
                    "thefreedictionary.com", "yourdictionary.com", "vocabulary.com", "wordnik.com", "wiktionary.org",
                    "collinsdictionary.com", "macmillandictionary.com")
WIKIPEDIA_HOSTS = ("wikipedia.org", "britannica.com", "encyclopedia.com", "wikiwand.com", "simple.wikipedia.org")
NEWS_HOSTS = ("bbc.com", "cnn.com", "reuters.com", "apnews.com", "nytimes.com", "theguardian.com", "washingtonpost.com",
              "forbes.com", "bloomberg.com", "techcrunch.com", "theverge.com", "wired.com", "arstechnica.com",
              "news.google.com", "news.yahoo.com", "hindustantimes.com", "timesofindia.com", "ndtv.com", "indianexpress.com")
FORUM_HOSTS = ("reddit.com", "quora.com", "stackoverflow.com", "stackexchange.com", "discourse.org", "answers.com", "askubuntu.com")
VIDEO_HOSTS = ("youtube.com", "vimeo.com", "dailymotion.com", "twitch.tv")
SOCIAL_HOSTS = ("twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "pinterest.com", "tiktok.com")
ACADEMIC_HOSTS = ("arxiv.org", "scholar.google.com", "researchgate.net", "academia.edu", "pubmed.ncbi.nlm.nih.gov", "ieee.org",
                  "acm.org", "sciencedirect.com")
AUTHORITY_HOSTS = ("github.com", "stackoverflow.com", "wikipedia.org", "mozilla.org", "w3.org", "python.org", "nodejs.org",
                   "docs.microsoft.com", "developer.apple.com", "developers.google.com", "aws.amazon.com")
BLOG_HINTS = ("blog", "medium.com", "dev.to", "hashnode")
DOC_HINTS = ("docs.", "documentation", "readme", "wiki.")
DEFINITION_HINTS = ("definition:", "meaning:", "noun.", "verb.", "adjective.")
BUSINESS_TLDS = (".com", ".co.in", ".in", ".io", ".co")
BUSINESS_TITLE = ("services", "products", "shop", "buy", "order", "pricing", "custom", "print", "tshirt", "t-shirt")
BUSINESS_TEXT = ("order", "buy", "price", "delivery", "shipping", "free", "discount", "off", "custom", "design")
EXPECTED = {"commercial": ("commercial", "forum", "news"), "definitional": ("wikipedia", "dictionary", "documentation"),
            "navigational": ("commercial", "documentation"), "informational": ("wikipedia", "blog", "documentation", "forum"),
            "local": ("commercial", "news"), "tutorial": ("blog", "documentation", "video", "forum"),
            "comparison": ("blog", "forum", "news"), "news": ("news", "blog")}
REASONING = ("why", "how", "explain", "compare", "analyze", "evaluate", "what causes", "what are the implications",
             "pros and cons", "difference between", "relationship between", "impact of", "best way to", "should i", "trade-offs")
FACTUAL = ("what is", "who is", "when was", "where is", "define", "meaning of", "definition of")
PIPELINE_STOP = "the a an is are was were what who when where why how in on at to for of with".split()
QUESTION_STARTS = "what who when where why how is are can should would".split()
MODEL_TIERS = {"simple": "llama-3.1-8b-instruct-fast", "moderate": "llama-3.3-70b-instruct-fp8-fast", "complex": "qwq-32b", "expert": "gpt-oss-120b"}
# word boundaries over all letters, as the patterns are meant
NW, NE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
LOCATIONS = (NW + r"in\s+([a-z][a-z]+(?:\s+[a-z][a-z]+)?)" + NE, NW + r"near\s+(?:me|([a-z][a-z]+))" + NE,
             NW + r"([a-z][a-z]+)\s+(?:based|located)" + NE)


def keywords(q: Column) -> Column:
    return F.filter(index_tokens(q), lambda w: w.rlike("^[a-z]{2,}$") & ~w.isin(KEYWORD_STOP))


def count_hits(words, c: Column) -> Column:
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def has_location(q: Column) -> Column:
    return q.rlike("(?i)" + "|".join(f"(?:{p})" for p in LOCATIONS))


def is_question(q: Column) -> Column:
    return q.rlike(r"(?i)^(what|how|why|when|where|who|which|can|does|is|are)\s")


def intent(q: Column) -> tuple[Column, Column]:
    """(intent, confidence), rules in fixed order."""
    low = F.lower(q)
    n, loc = count_hits(COMMERCIAL, low), has_location(q)
    rules = [(U.any_in(DEFINITIONAL, low), "definitional", F.lit(0.9)), (U.any_in(TUTORIAL, low), "tutorial", F.lit(0.85)),
             ((n >= 2) | ((n >= 1) & loc), "commercial", F.least(F.lit(0.9), n * 0.15 + 0.5)), (loc, "local", F.lit(0.75)),
             (U.any_in(COMPARISON, low), "comparison", F.lit(0.8)), (U.any_in(NEWS, low), "news", F.lit(0.75))]
    name, conf = F.lit("informational"), F.lit(0.5)
    for cond, label, c in reversed(rules):
        name, conf = F.when(cond, label).otherwise(name), F.when(cond, c).otherwise(conf)
    return name, conf


def result_type(url: Column, title: Column, text: Column) -> Column:
    h = F.regexp_replace(U.host(url), r"^www\.", "")
    t, s = F.lower(title), F.lower(text)
    business = U.any_in(BUSINESS_TLDS, h) & (U.any_in(BUSINESS_TITLE, t) | U.any_in(BUSINESS_TEXT, s))
    rules = [(U.any_in(DICTIONARY_HOSTS, h), "dictionary"), (U.any_in(WIKIPEDIA_HOSTS, h), "wikipedia"), (U.any_in(NEWS_HOSTS, h), "news"),
             (U.any_in(FORUM_HOSTS, h), "forum"), (U.any_in(VIDEO_HOSTS, h), "video"), (U.any_in(SOCIAL_HOSTS, h), "social"),
             (U.any_in(ACADEMIC_HOSTS, h), "academic"), (h.endswith(".gov") | h.endswith(".gov.in"), "government"),
             (U.any_in(BLOG_HINTS, h), "blog"), (U.any_in(DOC_HINTS, h), "documentation"), (U.any_in(DEFINITION_HINTS, s), "dictionary"), (business, "commercial")]
    out = F.lit("unknown")
    for cond, label in reversed(rules):
        out = F.when(cond, label).otherwise(out)
    return out


def intent_match(name: Column, kind: Column) -> Column:
    expected = F.lit(False)
    for k, v in EXPECTED.items():
        expected = expected | ((name == k) & kind.isin(*v))
    d = kind == "dictionary"
    return (F.when(expected, 0.15).when(name.isin("commercial", "local") & d, -0.2).when((name == "tutorial") & d, -0.15)
            .when((name == "commercial") & (kind == "wikipedia"), -0.05).otherwise(0.0))


def relevance_parts(kw: Column, query: Column, url: Column, title: Column, text: Column, kind: Column, name: Column) -> dict[str, Column]:
    """Components; keywords match as substrings."""
    n = F.greatest(F.size(kw), F.lit(1))
    found = lambda c: let(c, lambda x: F.size(F.filter(kw, lambda k: F.contains(x, k))))
    low = F.lower(text)
    return {
        "title_score": F.least(F.lit(0.35), found(F.lower(title)) / n * 0.35),
        "snippet_score": F.least(F.lit(0.35), found(low) / n * 0.25 + F.when(F.contains(low, F.lower(query)), 0.1).otherwise(0.0)),
        "url_score": F.least(F.lit(0.1), found(F.lower(url)) * 0.03),
        "authority": F.when(U.any_in(AUTHORITY_HOSTS, U.host(url)), 0.1).when(kind.isin("wikipedia", "documentation", "academic"), 0.08)
        .when(kind == "news", 0.05).otherwise(0.0),
        "intent_score": intent_match(name, kind)}


def total_relevance(parts: dict[str, Column], position: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts.values(), F.lit(0.0)) * (1 - position * 0.01)))


def research_relevance(query: Column, title: Column, text: Column, quality: Column, n_words: Column) -> Column:
    """.3 title term share + .4 content substring share + .2 quality + length bonus."""
    terms = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    n = F.greatest(F.size(terms), F.lit(1))
    in_title = F.size(F.array_intersect(terms, F.split(F.lower(title), r"\s+")))
    in_text = let(F.lower(text), lambda low: F.size(F.filter(terms, lambda w: F.contains(low, w))))
    return F.least(F.lit(1.0), in_title / n * 0.3 + in_text / n * 0.4 + quality * 0.2 + F.when(n_words >= 500, 0.1).when(n_words >= 200, 0.05).otherwise(0.0))


def complexity(q: Column) -> dict[str, Column]:
    low = F.lower(F.trim(q))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    n = F.size(words)
    reasoning, factual = U.any_in(REASONING, low), U.any_in(FACTUAL, low)
    level = F.when(reasoning | (n > 15), "complex").when(factual | (n < 5), "simple").otherwise("moderate")
    starts = F.lit(False)
    for w in QUESTION_STARTS:
        starts = starts | low.startswith(w)
    tier = F.lit(MODEL_TIERS["expert"])
    for k in ("complex", "moderate", "simple"):
        tier = F.when(level == k, MODEL_TIERS[k]).otherwise(tier)
    return {"complexity": level, "is_question": q.endswith("?") | starts,
            "intent": F.when(factual, "factual").when(reasoning, "analytical").when(U.any_in(("buy", "download", "sign up", "subscribe"), low), "transactional")
            .when(U.any_in(("login", "official", "website", "homepage"), low), "navigational").otherwise("informational"),
            "keywords": F.slice(F.filter(words, lambda w: ~w.isin(PIPELINE_STOP) & (F.length(w) > 2)), 1, 10),
            "tokens": n * 2, "model": F.when(reasoning, MODEL_TIERS["complex"]).otherwise(tier)}
