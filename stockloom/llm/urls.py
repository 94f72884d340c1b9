"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_rows

BITS, GRAMS = 15, (3, 4, 5)

# The small labelled table, written by hand: ordinary addresses of several languages and zones, and addresses of the kinds that crawls leave out.
ALLOWED_URLS = """
https://www.gardenersworld.co.uk/how-to/pruning-roses https://bergsteigen.at/touren/ortler http://museum-alte-post.de/ausstellung/2019 https://cuisine-bretonne.fr/recettes/galettes https://elpanadero.es/masa-madre
https://localhistory.ie/parish/records/ https://weather.northcoast.net/forecast/today https://riverwatch.ca/levels/2021 https://stationery.jp/shop/paper https://kirjasto.fi/aukioloajat
https://chess-openings.net/sicilian/najdorf https://opendata.city/transport/stops.csv https://blog.woodturner.com/lathe-basics https://docs.fastmatrix.io/guide/install https://knitting.community/patterns/socks
https://science-weekly.com/articles/plankton https://astronomie-verein.ch/beobachtung https://journal-biology.net/vol12/issue3 https://bahnhof.com/fahrplan/winter https://lehrerzimmer.de/mathematik/klasse7.html
https://university-press.com/catalogue/physics https://laboratoire-marin.fr/publications https://biblioteca-publica.es/horarios/verano https://teatro-romano.it/programma https://arquitectura.mx/proyectos/12
https://farmersalmanac.net/moon/phases https://farmhouse-kitchen.com/bread/rye https://orchard.farm/apples https://windfarm-research.net/papers/noise https://lighthouse-trust.uk/visit
https://timetable.rail.net/en/stations https://translation-notes.com/de/idiome https://hiking-trails.net/map/alps/7.html https://winter-sports.ch/langlauf https://windowmakers.com/sash/repair
https://newspaper-archive.net/1911/05/03 https://daily-courier.com/news/council https://thetimesofmidland.com/local https://nachrichten-nord.de/politik https://lejournaldesiles.fr/culture
https://elcorreo-sur.es/deportes https://photo-club.nl/fotos/herfst https://orchestra.org.uk/season https://music-school.net/piano/lessons https://guitar-tabs.net/folk
https://cooking-with-herbs.com/thyme https://tea-traders.com/assam http://coffeeroasters.net/brew/guide https://beekeepers.net/swarm/calendar https://birdwatch.com/en/12 https://insects.net/de/311
https://free-software-guide.net/editor/setup https://freedom-of-press.net/report https://freight-lines.com/routes https://trackandfield.net/results/2018 https://railtrack.com/gauge/history https://adaptive-learning.net/course
https://adsorption-science.net/isotherm https://shadows-in-art.com/baroque https://roads-and-bridges.com/project/5 https://adulteducation.net/courses/evening https://adult-literacy.com/reading https://pillowmakers.com/down
https://cheapside-history.com/street https://betterhomes-advice.com/insulation https://alphabets.net/greek https://tibet-travel.com/lhasa https://expertise.net/es/45 https://essex-walks.com/coast https://middlesex-school.net/term
https://spamalot-theatre.com/cast https://slotcar-club.com/races https://winemaking.com/harvest https://darwin-archive.net/letters https://pharmacology-notes.com/receptor https://hospital-saint-luc.be/service
https://loanword-dictionary.net/french https://viadukt.de/geschichte https://crackle-glaze.com/pottery https://torrential-rain-study.net/data https://escarpment.net/geology https://replicator-biology.com/dna
https://theothers.com/on/the/road https://anderes.com/er/und https://indienen.net/in/het https://oudestad.nl/wandeling https://laminas.es/de/arte https://stonereader.com/th https://ondes.fr/en/mer https://tionnary.com/word/list
https://handover.net/notes/9 https://verstehen.de/text/8 https://ouvertures.fr/fr/3 https://estudios.es/es/7 https://restoration.com/oak https://innsbruck-info.at/en/3 https://thorn.net/hedge https://eranthis.com/bulbs https://hendon.net/history
https://thesaurus-online.net/synonyms https://athens-guide.com/acropolis https://mathematics.net/proofs https://thatched-roofs.com/reed https://anthology.net/poems https://northandsouth.net/maps https://theatre-tickets.com/matinee https://ethnology.net/field https://panther-zoo.com/keepers https://relationship-advice.com/letters https://township.net/council https://friendship.net/pen https://goldfish.net/ponds https://finnish-english.com/verbs https://anthem-lyrics.net/nations
https://schule-am-see.de/klassen https://menthe.fr/jardin https://sterne.de/himmel https://anders.com/text https://ortho-spelling.net/rules https://rennes-a-velo.fr/plan https://lesen-lernen.de/uebung https://ledonline.net/circuits
"""
BLOCKED_URLS = """
https://royal-casino-online.com/bonus https://casinoslots.net/spin https://best-casino.bet/register http://777jackpots.com/play https://mega-jackpot.net/en https://pokerstake.com/deposit https://free-poker-chips.net/ https://online-betting-tips.com/today
https://livebets.net/odds https://freebetoffers.com/signup https://sportsbet-bonus.net/claim https://bets-for-free.com/join https://winbig-lottery.com/claim https://you-win-prize.net/iphone https://win-cash-now.com/ https://lucky-winner.club/gift
https://cheap-viagra.net/order https://buy-cialis-online.com/ https://discount-pills.com/no-prescription https://pills-express.net/cart https://cheapmeds.net/buy https://online-pharmacy-rx.com/generic https://dietpills-now.com/trial https://cheap-tramadol.com/
https://replica-watches.net/rolex https://cheap-replica-bags.com/ https://fake-designer.shop/sale https://payday-loans-fast.com/apply https://instant-loan.net/approve https://bad-credit-loans.com/ https://quick-cash-loan.net/now
https://xxx-videos.net/hot https://adult-cams.com/live https://adultdating.net/join https://hot-adult-x.com/ https://sexchat.xxx/room https://pornotube.net/video https://freeporn-hub.com/ https://escort-girls.net/city https://x-adult-tube.com/new https://blog.adultblog.net/post https://adultroom.com/toys
https://torrent-movies.net/download https://warez-zone.com/full https://cracked-software.net/keygen https://serial-crack.com/patch https://free-keygen.net/ https://nulled-scripts.com/theme
https://click-tracker.net/redirect https://adtracker.com/pixel https://ads-server.net/banner https://track-ads.com/c https://popup-ads.net/serve https://banner-exchange.com/ad https://adclicks.net/go https://ads.trackpixel.com/t
https://spamhost.net/mail https://bulk-spam.com/list https://link-farm.net/links https://linkfarm-seo.com/page1 https://spam-links.com/farm https://buy-backlinks.net/ https://contentfarm.net/spin https://seo-spam-farm.net/1
https://phishing-login.com/verify https://secure-update-account.net/login https://malware-download.com/exe https://free-antivirus-scan.net/alert https://account-verify.net/bank
https://miracle-cure.net/order https://get-rich-quick.com/secret https://work-from-home-cash.net/ https://crypto-doubler.com/invest https://bitcoin-giveaway.net/claim https://forex-signals-vip.com/ https://free-gift-cards.net/generator
"""


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block) of the labelled table."""
    return [(u, label) for urls, label in ((ALLOWED_URLS, 0), (BLOCKED_URLS, 1)) for u in urls.split()]


def spread(rows: list[tuple[str, int]], others: int = 4) -> list[tuple[str, int]]:
    """The rows, and each host again with the bare path and with paths of other rows of both labels: a path that any host may have says little."""
    out = list(rows)
    for n, (url, label) in enumerate(rows):
        host = url[: url.index("/", url.index("://") + 3)]
        out.append((host + "/", label))
        out += [(host + parts(rows[(n + 37 * (k + 1)) % len(rows)][0])[1], label) for k in range(others)]
    return out


def held_out_accuracy(rows: list[tuple[str, int]], parts_of: int = 5) -> tuple[int, int]:
    """(right, all) over all rows, each judged by a model that learns from the rows outside its fifth."""
    right = 0
    for k in range(parts_of):
        w = train(spread([r for n, r in enumerate(rows) if n % parts_of != k]))
        right += sum((score_of(w, *parts(u)) >= 0.5) == label for u, label in rows[k::parts_of])
    return right, len(rows)


def score_of(w: np.ndarray, host: str, path: str) -> float:
    f = features(host, path)
    return float(1 / (1 + np.exp(-(w[f].sum() / np.sqrt(max(1, len(f))) + w[-1]))))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host in lower case ASCII; both empty without ``://`` or for null."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host + path; ties to the first) that fits; null without one. Rules are a short list of parameters."""
    found = verdict = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found, verdict = F.when(fits, h + p).otherwise(found), F.when(fits, action).otherwise(verdict)
    return found, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, each marked with its part."""
    out = []
    for mark, text in ((17, f"^{host}$"), (71, f"^{path}$")):
        cps = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        for n in GRAMS:
            if len(cps) >= n:
                h = np.full(len(cps) - n + 1, mark * 31 + n, dtype=np.uint64)
                for k in range(n):
                    h = (h ^ cps[k : len(cps) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    return rest[:cut].lower(), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def train(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.5, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) by full-batch gradient steps with per-weight scaling; the same for the same rows."""
    found = [features(*parts(u)) for u, _ in rows]
    y = np.array([label for _, label in rows], float)
    owner, index = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
    scale = 1 / np.sqrt(np.maximum(1, np.array([len(f) for f in found])))
    w, seen = np.zeros(2**BITS + 1), np.full(2**BITS + 1, 1e-8)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))  # both labels weigh the same
    for _ in range(rounds):
        z = np.bincount(owner, w[index], len(y)) * scale + w[-1]
        error = (1 / (1 + np.exp(-z)) - y) * weight
        gradient = np.append(np.bincount(index, (error * scale)[owner], 2**BITS), error.sum()) + ridge * w / len(y)
        seen += gradient**2
        w -= rate * gradient / np.sqrt(seen)
    return w


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule``, ``verdict`` (the rule's, else block if the score reaches ``threshold``) and ``score``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed with score 0: nothing is known of them.
    Repeated rows are judged each. Very long urls are scored whole. Only id and url are read; empty tables give empty results. No shuffle;
    the weights (2^15 numbers) are a parameter of bounded size.
    """
    weights = pages.sparkSession.sparkContext.broadcast(train(spread(labelled if labelled is not None else labelled_urls())))
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def score(columns):
        w, hosts = weights.value, {}
        out = []
        for key in zip(columns[1], columns[2], strict=True):
            if key == ("", ""):
                out.append(0.0)
                continue
            if key not in hosts:
                hosts[key] = score_of(w, *key)
            out.append(hosts[key])
        return [*columns, out]

    kind = pages.schema[id_col].dataType.simpleString()
    scored = map_rows(rows, f"`{id_col}` {kind}, host string, path string, score double", score)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
