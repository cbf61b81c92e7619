"""Lines of a cached page: containers, their generalised paths and a first, local verdict for each line.

A page's text has no tags, so a container is a run of lines of one form (bullets, links, bare labels, segments of one
line, a plain line) and its path is that form with the label or masked line it holds. Offsets of lines count from 0
over the content split at every line feed; a carriage return at the end of a line is not part of it."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import urlsplit

# The wording of site furniture in the four page languages, each as a pattern for a whole line.
INSIDE = (
    # cookies and device data, newsletters, rights: weak cues, which count only outside the running text of a page
    "cookies", "small files on your device", "partners process device data", "gerätedaten", "speichert kleine dateien",
    "guarda pequeños archivos", "sus socios tratan", "enregistre de petits fichiers", "ses partenaires traitent",
    "newsletter", "in your inbox", "boletín", "all rights reserved", "alle rechte vorbehalten", "todos los derechos reservados",
    "tous droits réservés",
)
NOTICES = (
    # notices that scripts improve a page which is there
    r"some features of .* javascript", r"für einige funktionen von .* javascript", r"algunas funciones de .* javascript",
    r"certaines fonctions de .* javascript",
    # cookie and data notices
    r"we (?:and our partners )?use cookies\b", r"(?:this site|\S+(?: \S+)? and its partners) (?:stores small files|process(?:es)? device data)", r"by staying on .* you agree\b", r"cookies help us run\b",
    r"wir verwenden cookies\b", r"diese seite und ihre partner nutzen gerätedaten", r".{1,60} speichert kleine dateien auf", r"usamos cookies\b", r"utilizamos cookies\b", r"este sitio y sus socios tratan datos",
    r".{1,60} guarda pequeños archivos en", r"nous utilisons des cookies\b", r"ce site et ses partenaires traitent des données", r".{1,60} enregistre de petits fichiers sur",
    # newsletters
    r"(?:sign up for|subscribe to) (?:our|the) newsletter$", r"get the best of .* in your inbox", r"newsletter bestellen$", r"suscríbase al boletín$", r"enter your e-?mail", r"never miss a story", r"jede woche das beste von", r"ihre e-mail-adresse$",
    r"lo mejor de .* cada semana", r"su correo electrónico$", r"s'abonner à", r"chaque semaine, le meilleur",
    r"votre adresse électronique$", r"verpassen sie keine", r"no se pierda ning", r"ne manquez (?:rien|aucun)",
    # adverts
    r"(?:sponsored content|advertisement|ad - scroll on|continue reading below)$", r"(?:anzeige|werbung|weiterlesen nach der anzeige|gesponserter inhalt)$",
    r"(?:publicidad|contenido patrocinado|siga leyendo.*)$", r"(?:publicité|contenu sponsorisé|la suite après.*)$",
    # sharing and comments
    r"(?:share|print|save|tweet|pin|copy link|send to a friend|share this article|report this page|e-mail)(?:[ |/·,]+(?:share|print|save|tweet|pin|e-mail))*$",
    r"(?:teilen|drucken|merken|link kopieren|artikel teilen|seite melden|an freunde senden)(?:[ |/·,]+(?:teilen|drucken|merken))*$",
    r"(?:compartir|imprimir|guardar|copiar enlace|compartir este artículo|enviar a un amigo)(?:[ |/·,]+(?:compartir|imprimir|guardar))*$",
    r"(?:partager|imprimer|enregistrer|copier le lien|partager cet article|envoyer à un ami)(?:[ |/·,]+(?:partager|imprimer|enregistrer))*$",
    r"(?:leave a reply|be the first to comment|kommentar schreiben|deje un comentario|laisser un commentaire)$",
    r"\d[\d,.]* (?:comments?|kommentare?|comentarios?|commentaires?)$",
    # footers
    r"© ?\d", r"(?:back to top|nach oben|volver arriba|haut de page)$", r"(?:terms of use|impressum|aviso legal|mentions légales)\b.*\|",
    r"reproduction without written consent", r"powered by the\b",
    # breadcrumbs
    r"(?:you are here|sie sind hier|está en|vous êtes ici) ?:",
)
RELATED = (
    r"^(related articles|you may also like|most read today|trending now|read also)$", r"^more from [^.]{2,40}$",
    r"^(meistgelesen|das könnte sie auch interessieren|lesen sie auch)$", r"^mehr von [^.]{2,40}$",
    r"^(lo más leído|también le puede interesar|lea también)$", r"^más de [^.]{2,40}$",
    r"^(les plus lus|à lire aussi|vous aimerez aussi)$", r"^plus sur [^.]{2,40}$",
)
COMPANIES = (" media ltd, ", " verlag, ", " s.l., ", " sarl, ")
LABELS = frozenset((
    "home", "contact", "about", "jobs", "shop", "latest", "archive", "help", "search", "gallery", "log in", "sign up", "my account", "about us", "news", "login", "register",
    "startseite", "kontakt", "anmelden", "suche", "archiv", "hilfe", "stellen", "galerie", "neues", "laden", "über uns", "mein konto", "registrieren", "aktuelles", "impressum",
    "inicio", "contacto", "buscar", "archivo", "ayuda", "tienda", "empleo", "galería", "mi cuenta", "iniciar sesión", "registrarse", "acerca de", "noticias", "entrar",
    "accueil", "connexion", "recherche", "rechercher", "archives", "aide", "boutique", "emplois", "galerie", "mon compte", "se connecter", "s'inscrire", "à propos", "actualités",
))

_NOTICE = re.compile("|".join(NOTICES))
_RELATED = re.compile("|".join(RELATED))
_CRUMBS = re.compile(NOTICES[-1], re.I)
_DIGITS = re.compile(r"\d[\d,.]*")
_DIGIT = re.compile(r"\d")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)")
_BULLET = re.compile(r"^(?:[-*•–]|\d+[.)]) +")
_SPLIT = re.compile(r" *[|·»›>] *| +/ +")
_END = re.compile(r"[.!?…:][\"'»”)\]]*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


@lru_cache(maxsize=64)
def host_of(url: str | None) -> str:
    """Lower-case host without a leading www.; '' for a malformed url."""
    try:
        h = (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""
    return h[4:] if h.startswith("www.") else h


def masked(t: str) -> str:
    return _DIGITS.sub("#", t)


@lru_cache(maxsize=1 << 15)
def generalised(t: str, host: str) -> str:
    """A masked line as any site might have it: lower case, the words of the site's own name masked too."""
    return _WORD.sub(lambda m: "@" if len(m.group()) >= 4 and m.group() in host else m.group(), t.lower())


def running(t: str) -> bool:
    """Whether a line looks like running text: it ends like a sentence and has eight words or more."""
    return t[-1] in ".!?\"'»”" and t.count(" ") >= 7


def furniture(t: str) -> str:
    """'N' for a notice, 'H' for the heading of a list of other articles, 'W' for a line with a weak cue, '' otherwise;
    t is stripped, of any length."""
    low = t.lower()
    v = _wording(low) if len(low) <= 160 else _wording.__wrapped__(low)  # long lines seldom repeat
    if v:
        return v
    for x in INSIDE:
        if x in low:
            return "W"
    return ""


@lru_cache(maxsize=1 << 16)
def _wording(low: str) -> str:
    if _RELATED.match(low):
        return "H"
    if _NOTICE.match(low) or (low[-1] not in ".!?" and any([x in low for x in COMPANIES]) and _DIGIT.search(low)):
        return "N"
    return ""


def labels(t: str, host: str) -> tuple[str, tuple[str, ...]]:
    """Form and labels of a menu-like line, ('', ()) for any other.

    Forms: b bullet, l links of the own host, x links elsewhere, s segments, p plain label."""
    if "](" not in t and (", " in t or t[-1] in ".!?…:"):
        return "", ()
    return _labels(t, host) if len(t) <= 160 else _labels.__wrapped__(t, host)


@lru_cache(maxsize=1 << 15)
def _labels(t: str, host: str) -> tuple[str, tuple[str, ...]]:
    links = _LINK.findall(t) if "](" in t else None
    if links:
        rest = _LINK.sub("", _BULLET.sub("", t)).strip(" |·/»>-")
        if rest:
            return "", ()
        own = all(not u.startswith("http") or host_of(u) == host for _, u in links)
        return ("l" if own else "x"), tuple(a.strip() for a, _ in links)
    bullet = _BULLET.match(t)
    body = t[bullet.end() :] if bullet else t
    if _END.search(body):
        return "", ()
    if "\t" in body or _DIGIT.search(body):
        return "", ()
    parts = tuple(p for p in _SPLIT.split(body) if p)
    if not parts or any(len(p) > 40 or p.count(" ") > 3 for p in parts):
        return "", ()
    if len(parts) > 1:
        return "s", parts
    return ("b" if bullet else "p"), parts


def crumbs(t: str) -> tuple[str, ...]:
    """The segments of a breadcrumb that says what it is; none for other lines."""
    m = _CRUMBS.match(t)
    return tuple(p for p in _SPLIT.split(t[m.end() :].strip()) if p) if m else ()


def known(parts: tuple[str, ...]) -> int:
    return sum(p.lower() in LABELS for p in parts)


def read(content: str, url: str | None) -> list[tuple[int, str, str, str, tuple[str, ...]]]:
    """(line number, stripped line, verdict, form, labels) of each line that is not blank.

    Verdicts: N notice, advert, prompt, breadcrumb or footer; C weak cue of a notice; H heading and I item of a list of
    other articles; M menu; '' nothing known locally. A weak cue is a verdict only before or after all running text of the page, or where it has none."""
    host = host_of(url)
    out: list[list] = []
    listing = False
    previous = -2
    weak: list[int] = []
    first = last = -1
    for no, raw in enumerate(content.split("\n")):
        t = raw.strip()
        if not t:
            listing = False
            continue
        v = furniture(t)
        if v == "W":
            weak.append(len(out))
            v = ""
        elif not v and running(t):
            first, last = (len(out) if first < 0 else first), len(out)
        form, parts = ("", ()) if v else labels(t, host)
        if v == "H":
            listing = True
        elif v:
            listing = False
        elif listing and no == previous + 1:
            if form == "l" or form == "x" or not _END.search(_LINK.sub(r"\1", t)):
                v = "I"
            else:
                listing = False
        previous = no
        out.append([no, t, v, form, parts])
    for i in weak:
        if (first < 0 or i < first or i > last) and not out[i][2] and len(out) > 1:
            out[i][2:] = ["C", "", ()]
    _menus(out)
    return [tuple(x) for x in out]


def _menus(out: list[list]) -> None:
    """Marks runs of menu-like lines that hold known labels or link to the own host, and breadcrumbs above the title."""
    i = 0
    while i < len(out):
        form = out[i][3]
        if not form or out[i][2]:
            i += 1
            continue
        j = i
        while j < len(out) and out[j][3] == form and not out[j][2] and out[j][0] - out[i][0] == j - i:
            j += 1
        parts = [p for x in out[i:j] for p in x[4]]
        hits = known(tuple(parts))
        lone = j - i
        menu = False
        if form == "l":
            menu = len(parts) >= 2 or hits > 0
        elif form in "bp":
            menu = (lone >= 3 and hits >= max(1, lone // 8)) or (hits == lone and (form == "b" or i == 0))
        elif form == "s":
            menu = hits > 0 and len(parts) >= 2
        if menu:
            for x in out[i:j]:
                x[2] = "M"
        i = j
    top = 0
    while top < len(out) and out[top][2] in ("M", "N", "C"):
        top += 1
    if top < len(out) and out[top][3] == "s" and 2 <= len(out[top][4]) <= 4 and out[top][0] <= out[0][0] + 25 and len(out) > top + 1 and re.search(r" [/»›>] ", out[top][1]) and not any(x[3] == "s" for x in out[top + 1 : top + 3]):
        out[top][2] = "N"


def words(t: str) -> list[str]:
    return _WORD.findall(t)
