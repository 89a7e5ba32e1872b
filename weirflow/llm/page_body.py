"""Problem 5: lines of a page that belong to the site told from the page's own content.

Method: tag-path ratios. A page that has lost its markup still shows its structure: each
line is given a path from the root to a leaf, ``block/leaf``, from separators, bullets, the
heading a run of lines stands under, and what the line or its cells repeat (``bar`` for
menus, ``crumb``, ``notice``, ``links`` for what stands under a heading such as "related
articles", ``main`` for the rest; leaves are ``sentence``, ``short``, a bullet, a row). Text
length, sentence punctuation and repetition are aggregated per path over the page, fused
into one score with the block's weight, smoothed along each run of lines of one block, and
lines whose score stays below a threshold are furniture: long punctuated text is kept even
in a furniture block.

What a site repeats is counted over all pages (``repeated_lines``): a line or a menu's cell,
with its numbers and addresses left out, is repeated if a fixed share of the pages have it,
and if it is not a sentence that texts use within paragraphs as well. The lists of names,
headings and phrases below are a second sign beside that count, and the only one where no
counts are at hand (problems 1 and 3 read bodies without them). Garbled lines are read as
restored by problem 9's operator; lines that are lost are judged by their shape and place.

The count is one pass that leaves a table of fixed size; judging is one narrow pass without
any shuffle.

Defined results: null, empty and blank texts have no furniture; blank lines are never
furniture; lines are those between U+000A, counted from 0, a carriage return before it does
not matter; titles, headings, lists, tables and sentences of the page stay; repeated rows
come out as often as they went in; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import map_batches, summed
from weirflow.llm.garbled import Garbled, finder, openings, read_samples, suspect

#: Names of menu entries, by language.
MENU = {
    "english": "Home|About us|Contact|Help|Archive|Log in|Login|Sign in|Register|Topics|Search|FAQ|Courses|Sitemap|Language|Events calendar|Subscribe|Library|News|Gallery|Shop|Teachers|Resources|Products|Services|Blog|Forum|Careers|Downloads|Terms of use|Privacy|Privacy policy|Imprint|Accessibility|Cookies|Menu",
    "chinese": "首页|新闻动态|关于我们|手机版|登录|教师频道|帮助|商城|网站地图|注册|站内搜索|专题|联系我们|资料下载|往期回顾|课程中心|图片|活动日历|常见问题|繁體|繁体|简体|免责声明|隐私条款|法律声明|下载|论坛|博客|搜索|會員|会员中心|导航|首頁|登錄|註冊|幫助|聯繫我們|關於我們|網站地圖|新聞動態",
    "dutch": "Overzicht|Bibliotheek|Archief|Startpagina|Over ons|Winkel|Nieuws|Cursussen|Zoeken|Inloggen|Contact|Hulp|Voorwaarden|Privacy",
    "german": "Hilfe|Kontakt|Über uns|Bibliothek|Archiv|Anmelden|Laden|Kurse|Startseite|Suche|Aktuelles|Inhaltsübersicht|Impressum|Datenschutz|AGB",
    "french": "Recherche|Plan du site|Archives|Cours|Actualités|Bibliothèque|Accueil|Qui sommes-nous|Connexion|Boutique|Aide|Contact|Mentions légales|Confidentialité",
    "italian": "Archivio|Inizio|Notizie|Accedi|Chi siamo|Mappa del sito|Cerca|Aiuto|Biblioteca|Contatti|Negozio|Corsi|Note legali|Privacy",
    "spanish": "Biblioteca|Cursos|Iniciar sesión|Noticias|Mapa del sitio|Quiénes somos|Tienda|Buscar|Ayuda|Inicio|Contacto|Archivo|Aviso legal|Privacidad",
    "portuguese": "Biblioteca|Cursos|Início|Ajuda|Loja|Entrar|Notícias|Contato|Quem somos|Arquivo|Busca|Mapa do site|Aviso legal|Privacidade",
    "russian": "Архив|Войти|Магазин|Помощь|Главная|Новости|Карта сайта|Курсы|О нас|Библиотека|Контакты|Поиск|Правовая информация|Конфиденциальность",
    "japanese": "検索|過去記事|ログイン|ヘルプ|ホーム|講座|ショップ|お知らせ|図書室|お問い合わせ|サイトマップ|会社概要|利用規約|個人情報の取り扱い",
}
#: Headings under which links to other pages stand.
LINK_HEADS = "Recent posts|You may also like|Related articles|Most read(?: this week)?|More in this section|Tags|猜你喜欢|相关文章|本周热门|栏目推荐|标签|最新发布|猜您需要的商品|热门文章|推荐阅读|Lees ook|Meest gelezen|Meer over dit onderwerp|Meistgelesen|Mehr zum Thema|Ähnliche Artikel|Les plus lus|Sur le même sujet|À lire aussi|I più letti|Sullo stesso tema|Leggi anche|Lo más leído|También le puede interesar|Más sobre el tema|Mais lidas|Leia também|Mais sobre o assunto|Популярное|Ещё по теме|Читайте также|人気の記事|この分野の記事|関連記事|あわせて読みたい"
#: What a site says about itself, patterns from the start of the line.
NOTICES = (
    # dates, versions, addresses, owners
    r"©|\(c\) \d{4}|版权所有|Copyright ©|Last updated \d|Version [\d.]+ \(|Registered office|Powered by \w|Contact the editors|地址：|网站备案号|更新时间：|本站由|技术支持：|Bijgewerkt op|Mis à jour le|Aggiornato il|Actualizado el|Atualizado em|Обновлено \d|Stand: \d|最終更新",
    r"Terms of use|免责声明|Impressum ·|Mentions légales|Aviso legal|Note legali|Voorwaarden ·|Правовая информация|利用規約",
    r"Back to top|返回顶部|Nach oben|Naar boven|Haut de page|Torna su|Volver arriba|Voltar ao topo|Наверх$|ページの先頭へ",
    # consent
    r"We use cookies|This site stores|Your privacy matters|By clicking “Accept”|OK, got it|本网站使用缓存|我们重视您的隐私|我知道了$|为提供更好的服务|Wij gebruiken cookies|Wir verwenden Cookies|Nous utilisons des cookies|Usiamo i cookie|Usamos cookies|Мы используем файлы cookie|当サイトではクッキー|En poursuivant|Proseguendo|Al continuar|Ao continuar|Door verder te gaan|Durch die weitere Nutzung|Mit der weiteren Nutzung|Si continúa, acepta|閲覧を続けると|Продолжая",
    # log in, subscribe, share, rate, comment
    r"Already a member|Log in to|Sign up for|Subscribe to|Follow us|Share this|Leave a reply|Was this page helpful|Rate this page|Report an error|Add to favourites|Download our|\d+ comments? so far|Please enable JavaScript|Join the discussion",
    r"还没有账号|扫一扫|点赞（|上一篇：|下一篇：|举报错误|收藏本页|点击下载客户端|本文对您有帮助吗|订阅每周精选|已有\d+人评论|分享到：|登录后才能|请登录",
    r"Al lid\?|Plaats een reactie|Delen:|Meld u aan|Download de app|Schon Mitglied|Newsletter abonnieren|Teilen:|Kommentar schreiben|App herunterladen|Déjà membre|Laisser un commentaire|Partager :|Abonnez-vous|Télécharger l’app|Sei già iscritto|Lascia un commento|Condividi:|Iscriviti alla|Scarica l’app",
    r"¿Ya es miembro|Deje un comentario|Compartir:|Suscríbase|Descargue la aplicación|Já é membro|Deixe um comentário|Compartilhar:|Assine nosso|Baixe o aplicativo|Уже с нами|Оставить комментарий|Поделиться:|Подпишитесь|Скачать приложение|会員の方は|コメントを残す|シェアする|メールマガジン|アプリをダウンロード",
    # advertising
    r"Advertisement\b|Sponsored content|Continue reading below|Story continues after|Special offer|Looking for an? .{1,60}\? Order|Our partner .{1,80}see the offer|.{1,60} Academy: learn to|Anzeige$|Gesponserter Inhalt|Weiter nach der Werbung|Advertentie|Gesponsorde inhoud|Lees verder na de",
    r"广告$|推广内容|以下内容继续|限时优惠|【推荐】|想要.{1,40}吗？现在下单|.{1,40}厂家直销|.{1,30}学堂：\d+天学会|回答\d+个问题|Win an? .{1,60}! Answer \d+",
    r"Publicité|Contenu sponsorisé|La suite après la pub|Pubblicità|Contenuto sponsorizzato|Continua dopo la pub|Publicidad|Contenido patrocinado|Sigue después del anuncio|Conteúdo patrocinado|Continua após o anúncio|Реклама$|Материал партнёра|Продолжение после рекламы|広告|スポンサー記事",
    r"[^.!?。！？]{1,70}: -\d+ ?% ▸",
)
MORE = r"(?:…|\.\.\.|\[…\]|\[\.\.\.\])\s*(?:Read more|阅读全文|閱讀全文|Lire la suite|Leia mais|続きを読む|Читать далее|Leer más|Leggi tutto|Weiterlesen|Lees meer)\s*$"


def _by_opening(patterns: tuple[str, ...]) -> tuple[dict[str, re.Pattern], re.Pattern]:
    """The alternatives of the patterns by their first character, so that a line is held
    against few of them, and those that open with no fixed character."""
    found: dict[str, list[str]] = {}
    for p in re.split(r"\|(?![^(\[]*[)\]])", "|".join(patterns)):
        found.setdefault(p[0] if p[0] not in "\\.[(" else "", []).append(p)
    return {k: re.compile("|".join(v)) for k, v in found.items() if k}, re.compile("|".join(found.get("", ["(?!)"])))


_CUES, _CUE = _by_opening(NOTICES)
_OPEN_CUES = re.compile("Academy|▸|直销|学堂|comment|\\(c\\)")
_HEAD = re.compile("(?:" + LINK_HEADS + r")\s*[:：]?$")
_MAIL = re.compile("[\\w.-]+@[\\w.-]+\\.[a-z]{2,8}$")
_MORE = re.compile(MORE)
_NAMES = frozenset(n for v in MENU.values() for n in v.split("|"))
_PHRASES = ("未经许可不得转载", "联系邮箱", "All rights reserved", "Alle rechten voorbehouden", "Tous droits réservés", "Alle Rechte vorbehalten", "Todos os direitos", "Todos los derechos", "Tutti i diritti", "Все права защищены", "無断転載を禁じます")
_SEP = re.compile(r"\s*(?:\t|\s\|\s|\s[·•]\s|\s[>/»›]\s| {2,}|　)\s*")
_SEPARATED = re.compile("[\t|·•>/»›\u3000]|  ")
_CRUMB = re.compile(r"\s[>/»›▸→]\s")
_BULLET = re.compile(r"(?:([-•*»→›▸·–‣◦■□▪])\s+|(\(?\d{1,3}[.)）、]|[①-⑳]|[(（]?[a-zA-Z][.)])\s*)")
_ENDS = re.compile("[.!?。！？…,，;；、](?:[”\"』」»)）’]*|\\s*[»”])\\s*$")
_STOPS = re.compile("[.!?,;。！？，；、]")
_LOST = re.compile("[�锟斤拷]")
BLOCK_WEIGHT = {"main": 1.0, "links": 0.1, "bar": 0.1, "crumb": 0.1, "notice": 0.09, "lost": 0.1}
THRESHOLD = 1.3
TABLE_BITS = 21
REPEATED_SHARE, REPEATED_SHORT, REPEATED_PAGES, OUTSIDE = 6e-4, 2e-3, 5, 4
_NUMBER = re.compile(r"\d+")
_ADDRESS = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_DOTTED = re.compile(r"\w\.\w")
_LETTERS = re.compile(r"[^\W\d_]{2}")
_EDGE = "-•*»→›▸·«←>|.!?。！？…，,;；:： \t\r"
_CLAUSE = re.compile("[.!?…,;:]\\s|[。！？，；：、]")


def template(line: str) -> str:
    """What a line, a menu's cell or a clause repeats: itself without its numbers, addresses
    and the marks at its ends; '' for what has no word."""
    t = _NUMBER.sub("0", line)
    if _DOTTED.search(t):
        t = _ADDRESS.sub("@", t)
    t = t.strip(_EDGE)
    return t if _LETTERS.search(t) else ""


def _slot(t: str) -> int:
    return zlib.crc32(t.encode("utf-8", "surrogatepass")) & (1 << TABLE_BITS) - 1


def counted(text: str) -> tuple[set[int], set[int]]:
    """Places in the table of what a page has as lines or cells, and within paragraphs."""
    lines, inside = set(), set()
    text = _NUMBER.sub("0", text)
    for x in text.split("\n"):
        x = x.strip(_EDGE)
        if not x:
            continue
        t = _ADDRESS.sub("@", x) if _DOTTED.search(x) else x
        lines.add(t)
        if _SEPARATED.search(x) and len(parts := _SEP.split(t)) > 2:
            lines.update(p.strip(_EDGE) for p in parts)
        elif len(x) > 30:
            told = _CLAUSE.split(t)
            if len(told) > 1:
                inside.update(told)
    return set(map(_slot, lines)), {_slot(c.strip(_EDGE)) for c in inside}


class Repeated:
    """In how many pages a line is repeated, as a line and within paragraphs."""

    def __init__(self, lines: np.ndarray, inside: np.ndarray, pages: float):
        # What so many different lines meet in one place by chance is no repetition.
        least = max(REPEATED_PAGES, 3 * float(np.median(lines)))
        alone = lines >= OUTSIDE * inside
        self.long, self.short = (np.packbits(alone & (lines >= max(least, share * pages))) for share in (REPEATED_SHARE, REPEATED_SHORT))

    def __call__(self, line: str) -> bool:
        t = template(line)
        if not t:
            return False
        i = _slot(t)
        return bool((self.long if _ENDS.search(line[-16:]) else self.short)[i >> 3] >> (7 - (i & 7)) & 1)


def repeated_lines(documents: DataFrame) -> Repeated:
    """What the lines of all pages repeat. Copies of a page count once a task."""
    size = 1 << TABLE_BITS

    def count(batches) -> np.ndarray:
        n = np.zeros(2 * size + 1, np.int64)
        seen: set[int] = set()
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(h)
                lines, inside = counted(text)
                n[list(lines)] += 1
                n[np.fromiter(inside, np.int64, len(inside)) + size] += 1
                n[-1] += 1
        return n

    n = summed(documents.where("text is not null").select(F.xxhash64("text").alias("h"), "text"), count, 2 * size + 1)
    return Repeated(n[:size], n[size:-1], float(n[-1]))


@lru_cache(maxsize=50_000)
def _listed_leaf(line: str) -> tuple[str, str]:
    """Block and leaf of a stripped line by itself and the lists; the block ``head`` opens
    ``links``."""
    bare = line.lstrip("-•*»→›▸· ")
    if bare in _NAMES:
        return "bar", "entry"
    if len(bare) < 60 and _HEAD.match(bare):
        return "head", "head"
    first = _CUES.get(bare[:1])
    if first is not None and first.match(bare) or _OPEN_CUES.search(bare) and _CUE.match(bare) or any(p in bare for p in _PHRASES) or "@" in bare and _MAIL.search(bare):
        return "notice", "notice"
    if ("…" in line or "..." in line) and _MORE.search(line):
        return "links", "teaser"
    parts = _SEP.split(line) if _SEPARATED.search(line) else ()
    if len(parts) > 1:
        named = sum(p in _NAMES for p in parts)
        if named >= 2 and named >= 0.6 * len(parts):
            return "bar", "menu"
        if named and len(parts) <= 5 and _CRUMB.search(line) and parts[0] in _NAMES:
            return "crumb", "crumb"
    m = _BULLET.match(line)
    closed = _ENDS.search(line[-16:]) is not None
    if m and not (closed and len(line) > 60):
        return "main", m.group(1) or "#"
    if len(line) > 60 or closed:
        return "main", "sentence"
    return "main", "short"


@lru_cache(maxsize=50_000)
def _counted_leaf(line: str, known: Repeated) -> tuple[str, str]:
    """The same by the lists and by what the line repeats; ``single`` may open ``links``."""
    own = _listed_leaf(line)
    if own[0] != "main":
        return own
    parts = _SEP.split(line) if _SEPARATED.search(line) else ()
    if len(parts) > 1:
        named = sum(p in _NAMES or known(p) for p in parts)
        if len(parts) > 2 and named >= 0.6 * len(parts):
            return "bar", "menu"
        if named and len(parts) <= 5 and _CRUMB.search(line) and (parts[0] in _NAMES or known(parts[0])):
            return "crumb", "crumb"
    if not known(line):
        return own
    return ("single", "short") if len(line) <= 30 and not _ENDS.search(line) else ("notice", "notice")


def paths(lines: list[str], known: Repeated | None = None) -> list[tuple[str, str] | None]:
    """Block and leaf of each line in its place; None for blank lines."""
    own = [_listed_leaf(x) if x else None for x in lines] if known is None else [_counted_leaf(x, known) if x else None for x in lines]
    if not any(p is not None and p[0] in ("head", "single") for p in own):
        return own
    spaced = sum(a is None for a in own) >= 0.4 * max(1, len(own) - 1)
    filled = [i for i, p in enumerate(own) if p]
    if known is not None:
        # A repeated short line opens links where one more kind of short lines follows it;
        # beside other furniture it is a menu's entry.
        for i, j in zip(filled, [*filled[1:], None]):
            if own[i][0] == "single":
                opens = j is not None and own[j][0] == "main" and own[j][1] != "sentence"
                own[i] = ("head", "head") if opens else ("bar", "entry")
    after = {i: own[j] for i, j in zip(filled, filled[1:])}
    at = 0
    while at < len(filled):
        i = filled[at]
        at += 1
        if own[i][0] != "head":
            continue
        own[i] = ("links", "head")
        kind, last = None, i
        while at < len(filled):
            j = filled[at]
            block, shape = own[j]
            if block in ("head", "bar", "notice", "crumb"):
                break
            gap = j - last > 1
            if gap and not spaced and (kind is not None or shape in ("short", "sentence")):
                break
            if block == "main" and (shape == "sentence" or kind is not None and shape != kind):
                break
            if block == "main" and kind is not None and shape == "short" and spaced and after.get(j, ("", ""))[1] == "sentence" and after.get(j, ("", ""))[0] == "main":
                break
            if kind is None:
                kind = shape
            if block == "main":
                own[j] = ("links", shape)
            last = j
            at += 1
    return own


def scores(lines: list[str], own: list[tuple[str, str] | None]) -> list[float | None]:
    """Score of each line: text length and punctuation per path of the page, fused with the
    weight of the block and smoothed along the runs of one block."""
    size: dict[tuple[str, str], list[float]] = {}
    for x, p in zip(lines, own):
        if p:
            s = size.setdefault(p, [0, 0, 0])
            s[0] += 1
            s[1] += len(x)
            s[2] += len(_STOPS.findall(x))
    ratio = {p: BLOCK_WEIGHT[p[0]] * (1 + math.log1p(chars / n)) * (1 + min(1.0, stops / n / 3)) for p, (n, chars, stops) in size.items()}
    out: list[float | None] = [None if p is None else ratio[p] for p in own]
    filled = [i for i, p in enumerate(own) if p]
    smooth = list(out)
    for k, i in enumerate(filled):
        total, weight = 2 * out[i], 2
        for j in filled[max(0, k - 1):k] + filled[k + 1:k + 2]:
            if own[j][0] == own[i][0]:
                total += out[j]
                weight += 1
        smooth[i] = total / weight
    return smooth


def _lost_lines(lines: list[str], own: list[tuple[str, str] | None]) -> None:
    """Lines that are lost: short ones before the first and after the last long line are
    taken for furniture, but for the last short one before the text (its title)."""
    filled = [i for i, p in enumerate(own) if p]
    if not any(p and p[0] == "main" and p[1] != "sentence" and _LOST.search(lines[i]) for i, p in enumerate(own)):
        return
    long = [i for i in filled if len(lines[i]) > 60]
    if not long:
        return
    head = [i for i in filled if i < long[0] and own[i][0] == "main"]
    tail = [i for i in filled if i > long[-1] and own[i][0] == "main"]
    for i in (head[:-1] if len(head) > 1 else []) + tail:
        if 4 * len(_LOST.findall(lines[i])) >= len(lines[i]):
            own[i] = ("lost", "short")
    for i in head:
        if _CRUMB.search(lines[i]) and _LOST.search(lines[i]):
            own[i] = ("lost", "menu")


def furniture(lines: list[str], known: Repeated | None = None) -> list[bool]:
    """Which of the (restored, stripped) lines of one page are furniture."""
    own = paths(lines, known)
    _lost_lines(lines, own)
    return below(lines, own)


def below(lines: list[str], own: list[tuple[str, str] | None]) -> list[bool]:
    """Which lines' scores stay below the threshold. No score of ``main`` does, as its weight
    is 1 and a line's length alone adds ln 2 at least, and runs are smoothed by themselves;
    so a page without other blocks need not be scored."""
    if all(p is None or p[0] == "main" for p in own):
        return [False] * len(own)
    return [s is not None and s < THRESHOLD for s in scores(lines, own)]


def page_lines(text: str, g: Garbled) -> tuple[list[str], list[bool]]:
    """The page's lines, restored and stripped, and which of them were garbled."""
    lines = [x.strip() for x in text.split("\n")]
    hit = [False] * len(lines)
    if not text.isascii() and openings().search(text):
        for i, x in enumerate(lines):
            if suspect(x):
                fixed, bad, _ = g.restore(x)
                if bad:
                    lines[i], hit[i] = fixed.strip(), True
    return lines, hit


def page_furniture(text: str | None, g: Garbled, known: Repeated | None = None) -> list[bool]:
    """Which lines of a page's text are furniture."""
    if not text or not text.strip():
        return []
    return furniture(page_lines(text, g)[0], known)


def furniture_lines(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """``doc_id, line_no`` of the furniture of each page."""
    samples = read_samples(lang_samples)
    sent = documents.sparkSession.sparkContext.broadcast(repeated_lines(documents))

    def find(batch: pa.RecordBatch):
        g, known = finder(samples), sent.value
        ids, numbers = [], []
        keys = batch.column(0).to_pylist()
        for key, text in zip(keys, batch.column(1)):
            for no, bad in enumerate(page_furniture(text.as_py(), g, known)):
                if bad:
                    ids.append(key)
                    numbers.append(no)
        yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(numbers, type=pa.int32())], ["doc_id", "line_no"])

    return map_batches(documents.select("doc_id", "text"), find, "doc_id bigint, line_no int")


def main_body(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """``doc_id, body, lines_kept, lines_dropped``: each page without its furniture; the kept
    lines are as they were. Null texts give a null body."""
    samples = read_samples(lang_samples)
    sent = documents.sparkSession.sparkContext.broadcast(repeated_lines(documents))

    def strip(batch: pa.RecordBatch):
        g, known = finder(samples), sent.value
        bodies, kept, dropped = [], [], []
        for text in batch.column(1):
            t = text.as_py()
            if not t:
                bodies.append(t)
                kept.append(0)
                dropped.append(0)
                continue
            bad = page_furniture(t, g, known)
            lines = t.split("\n")
            body = [x for x, b in zip(lines, bad) if not b] if bad else lines
            bodies.append("\n".join(body))
            kept.append(len(body))
            dropped.append(len(lines) - len(body))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, type=pa.string()), pa.array(kept, type=pa.int32()), pa.array(dropped, type=pa.int32())], ["doc_id", "body", "lines_kept", "lines_dropped"])

    return map_batches(documents.select("doc_id", "text"), strip, "doc_id bigint, body string, lines_kept int, lines_dropped int")
