"""Line-first cleaning of documents, with DataFrame functions only."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

# How a sentence may end, and what marks navigation and boilerplate, in English, French, German and Spanish.
SENTENCE_END = r"[.!?…:;。！？：；][\"'”’»«)\]]*$"
NAVIGATION_WORDS = (
    "home, menu, next, previous, prev, back, top, search, login, log in, sign in, sign up, register, share, tweet, print, read more, more, skip to content, contact us, about us, sitemap, "
    "accueil, suivant, précédent, retour, haut de page, rechercher, recherche, connexion, se connecter, s'inscrire, partager, imprimer, lire la suite, en savoir plus, contactez-nous, plan du site, "
    "startseite, weiter, zurück, nach oben, suche, anmelden, einloggen, registrieren, teilen, drucken, weiterlesen, mehr lesen, kontakt, impressum, über uns, "
    "inicio, siguiente, anterior, volver, arriba, buscar, iniciar sesión, registrarse, compartir, imprimir, leer más, contacto, sobre nosotros, mapa del sitio"
).split(", ")
PHRASES = (
    "all rights reserved, cookie policy, privacy policy, terms of use, terms of service, lorem ipsum, javascript, enable cookies, click here, subscribe to, ©, licensed under, this work is licensed, "
    "tous droits réservés, politique de confidentialité, mentions légales, conditions d'utilisation, cliquez ici, abonnez-vous, "
    "alle rechte vorbehalten, datenschutzerklärung, nutzungsbedingungen, cookie-richtlinie, klicken sie hier, newsletter abonnieren, "
    "todos los derechos reservados, política de privacidad, política de cookies, aviso legal, términos de uso, haga clic, suscríbete"
).split(", ")
NAVIGATION = "^(" + "|".join(NAVIGATION_WORDS) + r")[\x20\x09]*[>»|:.]*$"
LINK_ROW = r"^[^.!?]*([|»>·•][^|»>·•]*){3,}$"
BOILERPLATE = "(" + "|".join(PHRASES) + ")"


@dataclass(frozen=True)
class Rules:
    """Production thresholds. A document is rejected if its kept lines hold less than min_kept of its words, or fewer than
    min_words. heading_words: a line of at most so many words may be a heading, and needn't end as a sentence. menu_words,
    menu_times: a line of at most so many words that stands in a text so often is navigation in any language."""

    min_words: int = 50
    max_repeat: float = 0.5
    min_kept: float = 0.7
    max_symbol_words: float = 0.3
    max_upper: float = 0.6
    heading_words: int = 10
    menu_words: int = 4
    menu_times: int = 3


def words_of(text: Column) -> Column:
    """The words of a text; none for null or blank."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+", -1))


def line_fails(line: Column, suspect: Column, menus: Column, rules: Rules) -> Column:
    """Whether a line with a word breaks a punctuation, navigation or boilerplate rule. Each costly test stands behind a
    cheap one that it implies; suspect tells that the text holds a boilerplate phrase, menus are its lines that stand there
    again and again."""
    bare = F.btrim(line, F.lit(BLANKS))
    n_words = F.size(F.split(bare, f"{SPACE}+", -1))
    marked = F.size(F.filter(F.split(bare, f"{SPACE}+", -1), lambda w: w.rlike(r"[#*$%&|<>!]{2,}$|^[#*$%&|<>]+$")))
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(bare, r"[^\p{Lu}]+", ""))
    return (
        ~bare.rlike(r"[\p{L}\p{N}]")
        | (~bare.rlike(SENTENCE_END) & (n_words > rules.heading_words))
        | (bare.rlike(r"[#*$%&|<>!]") & (marked > rules.max_symbol_words * n_words))
        | (bare.rlike(r"\p{Lu}\P{L}*\p{Lu}") & (letters > 20) & (upper > rules.max_upper * letters))
        | bare.rlike("(?iu)" + NAVIGATION)
        | (bare.rlike("[|»>·•]") & bare.rlike(LINK_ROW))
        | ((F.size(menus) > 0) & F.array_contains(menus, bare))
        | (suspect & bare.rlike("(?iu)" + BOILERPLATE))
    )


def _short_lines(lines: Column, rules: Rules) -> Column:
    """The short ones among lines, bare and sorted; none where fewer lines are there than make a menu."""
    bare = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.size(F.split(x, f"{SPACE}+", rules.menu_words + 1)) <= rules.menu_words)
    return F.when(F.size(lines) >= rules.menu_times, F.sort_array(bare)).otherwise(F.array().cast("array<string>"))


def assess(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """Adds to docs one struct column, quality: the base counts, base_failed, the text of its lines that pass (clean_text),
    kept_words and kept.

    Every line with a word is judged by itself; failing lines are removed; a document is kept if its base counts pass and
    its lines keep at least rules.min_kept of its words and rules.min_words of them. Lines without a word carry no
    evidence and stay only between kept lines' breaks. Null or blank text: no words, base_failed, not kept, clean_text
    empty. Repeated rows are judged each; a column named quality is replaced; names starting with _q_ are reserved; every
    other column passes through. One row at a time and no shuffle, so no group can be hot.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c != "quality" and not c.startswith("_q_")]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    low = F.lower(t)
    suspect = functools.reduce(lambda x, y: x | y, [F.contains(low, F.lit(p)) for p in PHRASES])
    step = docs.select(*own, words_of(t).alias("_q_words"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("_q_lines"), suspect.alias("_q_suspect"))
    step = step.select("*", _short_lines(F.col("_q_lines"), rules).alias("_q_short"))
    step = step.select(
        "*",
        F.when(F.size("_q_words") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("_q_words") - 3), lambda i: F.xxhash64(F.get("_q_words", i), F.get("_q_words", i + 1), F.get("_q_words", i + 2))))
        .alias("_q_three"),
        F.array_distinct(F.filter("_q_short", lambda x, k: F.coalesce(F.get("_q_short", k + (rules.menu_times - 1)) == x, F.lit(False)))).alias("_q_menus"),
    )
    step = step.select("*", F.filter("_q_lines", lambda x: ~line_fails(x, F.col("_q_suspect"), F.col("_q_menus"), rules)).alias("_q_good"))
    # Sorted windows with their places only where some window occurs twice.
    step = step.select("*", F.when(F.size(F.array_distinct("_q_three")) == F.size("_q_three"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("_q_three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_q_sorted"))
    same = lambda k, x: F.coalesce(F.get("_q_sorted", k)["h"] == x["h"], F.lit(False))
    step = step.select("*", F.sort_array(F.transform(F.filter("_q_sorted", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])).alias("_q_places"))
    spread = F.transform("_q_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_q_places", k + 1) - p, F.lit(3))))
    step = step.select("*", F.aggregate(spread, F.lit(0), lambda a, x: a + x).cast("long").alias("_q_repeat"), F.size("_q_words").cast("long").alias("_q_n"), F.concat_ws("\n", "_q_good").alias("_q_clean"))
    step = step.select("*", F.size(words_of(F.col("_q_clean"))).cast("long").alias("_q_kept"), ((F.col("_q_n") < rules.min_words) | (F.col("_q_repeat") * 100 > F.col("_q_n") * int(100 * rules.max_repeat))).alias("_q_failed"))
    found = F.struct(
        F.col("_q_n").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"),
        F.col("_q_failed").alias("base_failed"),
        F.col("_q_clean").alias("clean_text"),
        F.col("_q_kept").alias("kept_words"),
        (~F.col("_q_failed") & (F.col("_q_kept") >= rules.min_words) & (F.col("_q_kept") * 100 >= F.col("_q_n") * int(100 * rules.min_kept))).alias("kept"),
    )
    return step.select(*own, found.alias("quality"))


#: DuckDB's equivalent of the op2 query over the view documents.
ORACLE = r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
s as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from d),
p as (select rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] g from (select rid, w, unnest(range(1, len(w) - 1)) i from s)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) n from p) where n > 1),
c as (select rid, count(distinct i + k) n_repeat_words from r, (values (0), (1), (2)) v(k) group by rid),
l as (select rid, x, k, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') b
      from (select rid, unnest(lines) x, unnest(range(len(lines))) k from s)),
m as (select rid, x, k, b, regexp_split_to_array(b, '[\x20\x09-\x0D]+') ws, length(regexp_replace(b, '[^\pL]', '', 'g')) letters,
        length(regexp_replace(b, '[^\p{Lu}]', '', 'g')) uppers, count(*) over (partition by rid, b) times from l),
g as (select rid, len(ws) n from m where not (
        length(regexp_replace(b, '[^\pL\pN]', '', 'g')) = 0
        or (len(ws) > 10 and not regexp_matches(b, $$SENTENCE_END$$))
        or len(list_filter(ws, lambda v: regexp_matches(v, '[#*$%&|<>!]{2,}$|^[#*$%&|<>]+$'))) > 0.3 * len(ws)
        or (letters > 20 and uppers > 0.6 * letters)
        or (len(ws) <= 4 and times >= 3)
        or regexp_matches(b, '(?i)' || $$NAVIGATION$$) or regexp_matches(b, $$LINK_ROW$$) or regexp_matches(b, '(?i)' || $$BOILERPLATE$$))),
k as (select rid, sum(n) kept_words from g group by rid),
f as (select doc_id, len(w)::bigint n_words, coalesce(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 0)::bigint word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(kept_words, 0)::bigint kept_words
      from s left join c using (rid) left join k using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and kept_words >= 50 and 100 * kept_words >= 70 * n_words as kept,
  kept_words from f
"""
for _name, _value in (("SENTENCE_END", SENTENCE_END), ("LINK_ROW", LINK_ROW), ("NAVIGATION", NAVIGATION), ("BOILERPLATE", BOILERPLATE)):
    ORACLE = ORACLE.replace(f"$${_name}$$", "'" + _value.replace("'", "''") + "'")
