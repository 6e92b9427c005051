"""Words that a page's own messages are made of, by language, and whether an element is such a message.

A message or notice names a thing of the page (the page, the browser, scripts, the session) and a state of it or what to do (expired, denied, not found, turn on), and says
hardly anything else. So an element of any length is a message if, in one of the languages, it has a word of either kind and nearly
all its words are of these kinds or function words. A sentence of an article about such things has other words as well.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: For each language, things of a page, states and orders, states that count where they are denied, denials, and words that say nothing by themselves; * stands for any ending.
VOCABULARY = {
    "en": (
        "page pages site website browser browsers javascript script scripts scripting cookies session server servers request requests access article story content database connection error errors gateway file url address "
        "resource text paragraph copy placeholder captcha network service proxy javascripts",
        "unavailable expired expires denied disabled required requires enable* reload refresh forbidden maintenance timeout timed moved removed deleted unauthorized unauthorised replace* dummy sample failed outdated "
        "permission blocked broken internal bad gone down turn checking slow unsupported cannot couldn wrong edit unexpected needs offline overloaded temporarily retry invalid filler",
        "found find available exist exists supported located loaded load complete completed process processed fulfilled established",
        "not no t cannot couldn longer nothing",
        "the a an of on in at to for from with and or not no nor is are was were be been being has have had it its this that these those you your our we us they them there here can could may might will would shall should "
        "must do does did don doesn didn isn aren wasn won t s re ve ll please sorry again later back shortly soon try trying moment minute minutes while time times more longer any many too so than but if as by i me my their "
        "own number code codes line view show shows showing shown run runs need needed want wants before after continue continuing proceed go going live then start writing delete it says say nothing meant only how final out "
        "date region country log sign signed in up requested looking what who when which where some something thing things an up went like first your let make sure using use used technical visit visitor visiting check home "
        "new old other latest version switch allow support full",
    ),
    "de": (
        "seite seiten website webseite browser javascript skripte skript sitzung server serverfehler anfrage anfragen zugriff beitrag artikel inhalt inhalte datenbank verbindung fehler cookies text absatz blindtext adresse "
        "datei dienst",
        "abgelaufen verweigert berechtigung veraltet deaktiviert aktivier* wartung wartungsarbeiten fehlgeschlagen interner ersetz* blindtext gesperrt versuchen benötigt erforderlich neu unbekannt gelöscht verschoben "
        "serverfehler platzhalter fülltext mustertext überlastet",
        "gefunden verfügbar erreichbar existiert dargestellt anzeigen hergestellt",
        "nicht kein keine mehr",
        "der die das den dem des ein eine einen einem einer und oder nicht kein keine ist sind war wird werden wurde sei hat haben hatte kann können konnte könnte soll sollte muss müssen darf ohne mit für von vom zu zum zur "
        "bei beim in im an am auf aus um nach vor es er sie wir ihr ihre ihren ihrem uns unser unsere diese dieser dieses diesen dies hier da leider bitte später noch einmal erneut nun nur wie was wenn dass so mehr wieder "
        "zeigt zeigen steht läuft schrift sagt nichts sich angeforderte gesuchte vorübergehend wegen fortzufahren weiter melden anmelden moment minuten eigenen eigene inhalt code zeile veröffentlichung erst durch ihnen "
        "derzeit zurzeit zurück bald als auch",
    ),
    "fr": (
        "page site session contenu serveur article javascript script scripts navigateur erreur texte paragraphe accès requête requêtes cookies base lien connexion fichier service",
        "introuvable expiré expirée reconnectez refusé refusée droits maintenance interne réessay* activ* désactiv* requis nécessite faux remplac* indisponible interdit obsolète supprimé supprimée échoué rechargez permission "
        "autorisation factice exemple remplissage",
        "trouvée trouvé disponible existe afficher",
        "ne n pas plus",
        "le la les l un une des du de d au aux et ou ne n pas plus ni est sont était a ont ce c cet cette ces s se sa son vous votre vos nous notre il elle ils on qui que qu quoi où dans en sur sous par pour avec sans à y "
        "peut peuvent pouvez pouvoir doit devra être été veuillez désolé ici tard bientôt revient retour moment minutes demandée recherchée nécessaires continuer montre seulement mise propre dit rien seul comment si encore "
        "avant après votre code ligne fonctionner",
    ),
    "es": (
        "contenido sesión artículo página páginas sitio servidor javascript script scripts navegador error texto párrafo acceso solicitud solicitudes base conexión cookies archivo servicio web",
        "caducado caducó denegado mantenimiento activ* desactiv* interno intentar* intente intentelo inténtelo relleno sustitu* necesita requiere muestra escriba prohibido eliminad* expirado obsoleto reemplac* falló recargue "
        "ejemplo",
        "disponible encontrad* existe mostrarse iniciada",
        "no",
        "el la los las lo un una unos unas de del al a y o u no ni es son era está están ha han haber hay que se su sus este esta estos estas esto ese esa aquí para por con sin en sobre le les nos nuestro nuestra usted "
        "ustedes puede pueden poder debe volverá vuelva más tarde pronto inicie nuevo ya solo sólo composición ver mostrar solicitada buscada continuar siento lo sentimos favor momento minutos código línea antes después "
        "propio como cuando si ser sea permiso",
    ),
    "pt": (
        "sítio site javascript artigo página páginas texto acesso erro servidor navegador sessão conteúdo parágrafo pedido pedidos base ligação cookies script scripts ficheiro serviço",
        "manutenção ativ* desativ* negado enchimento substitu* expirou interno indisponível exemplo requer necessita proibido removid* tente falhou recarregue desatualizado",
        "disponível existe encontrad*",
        "não já",
        "o a os as um uma uns de do da dos das no na nos nas ao à e ou não nem é são era está estão foi ser tem têm há que se seu sua seus este esta estes estas isto aqui para por com sem em sobre lhe nos nosso nossa pode "
        "podem poder deve já só mais tarde breve novo novamente mostra mostrar composição ver pedida procurada continuar desculpe lamentamos favor momento minutos código linha antes depois próprio como quando ser seja "
        "permissão",
    ),
    "it": (
        "pagina pagine sito javascript script articolo testo accesso errore server browser sessione contenuto paragrafo richiesta richieste database connessione cookie file servizio web",
        "manutenzione attiv* disattiv* negato scadut* interno riprov* riempitivo sostitu* richied* esempio autorizzazione vietato rimoss* fallit* ricaric* obsoleto aggiornare segnaposto",
        "trovat* disponibile esiste",
        "non",
        "il lo la i gli le l un uno una di del dello della dei delle da dal dalla in nel nella su sul sulla con per a al alla e o non né è sono era sta stato stata ha hanno che si suo sua questo questa questi queste qui ci "
        "vi voi noi nostro nostra può possono potere deve più tardi presto nuovo ancora mostra solo vedere cercata richiesta continuare spiacenti favore momento minuti codice riga prima dopo proprio come quando se sarà "
        "permesso",
    ),
    "nl": (
        "pagina site website javascript script scripts artikel tekst toegang fout fouten server browser sessie inhoud alinea verzoek verzoeken database verbinding cookies bestand dienst",
        "onderhoud inschakelen schakel uitgeschakeld geweigerd toestemming verlopen interne vervang* voorbeeldtekst voorbeeld vereist verouderd verboden verwijderd mislukt herlaad opvultekst nodig",
        "gevonden beschikbaar bestaat ondersteund geladen",
        "niet geen",
        "de het een en of niet geen is zijn was waren wordt worden werd heeft hebben had kan kunnen kon moet moeten mag zonder met voor van te ten ter bij in op aan uit om naar er hij zij ze wij we u uw je jouw ons onze deze "
        "dit die dat hier helaas alstublieft later nog opnieuw weer nu alleen hoe wat als dan meer toont staat zegt niets zich gevraagde gezochte tijdelijk wegens door te gaan verder aan probeer moment minuten eigen code "
        "regel eerst terug binnenkort ook",
    ),
    "ru": (
        "страниц* сайт* статья статьи статью javascript скрипт* сервер* доступ ошибка браузер* сессия содержимое текст текста абзац запрос* база соединение файл* сервис работы",
        "недоступ* запрещ* включите технические замените пример устарел* истекла отключ* требуется удален* заполнитель нужны обновите перемещена временно",
        "найден* существует доступна",
        "не нет больше недоступ*",
        "и или не нет ни в во на с со по к ко из от до для при за о об это этот эта эти вы ваш ваша ваши мы наш наша он она оно они его её их что чтобы как так уже больше ещё позже пожалуйста извините здесь тут пока ведутся "
        "зайдите попробуйте снова продолжить запрошенная который которая показывает вид своим свой скоро вернётся код строка минут нельзя можно был была было будет только",
    ),
}
#: Share of an element's words that must be of the vocabulary.
COVERED = 0.85
LANGUAGES = tuple(VOCABULARY)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@lru_cache(1)
def _roles() -> tuple[dict[str, int], list[tuple[str, int]]]:
    """Bits of each listed word, five for each language (thing, state, state if denied, denial, listed at all), and those of beginnings of words."""
    whole: dict[str, int] = {}
    begins: list[tuple[str, int]] = []
    for i, kinds in enumerate(VOCABULARY.values()):
        for kind, words in enumerate(kinds):
            bits = (16 | 1 << kind) << 5 * i
            for w in words.split():
                if w.endswith("*"):
                    begins.append((w[:-1], bits))
                else:
                    whole[w] = whole.get(w, 0) | bits
    return whole, begins


@lru_cache(200_000)
def _role(word: str) -> int:
    whole, begins = _roles()
    bits = whole.get(word, 0)
    for stem, b in begins:
        if word.startswith(stem):
            bits |= b
    if not bits and "-" in word and all(parts := [_role(w) for w in word.split("-")]):
        for b in parts:
            bits |= b
    return bits


def is_message(element: str) -> bool:
    """Whether a text is nothing but a message of the page about itself."""
    roles, both, name = [], 0, False
    for w in _WORD.findall(element):
        r = _role(w.lower())
        both |= r
        if r or not name:  # a name of several words counts as one
            roles.append(r)
        name = not r and w[0].isupper()
    for i in range(len(LANGUAGES)):
        kinds = both >> 5 * i
        if kinds & 1 and (kinds & 2 or kinds & 12 == 12):
            listed = 16 << 5 * i
            if sum(r & listed > 0 for r in roles) >= COVERED * len(roles):
                return True
    return False
