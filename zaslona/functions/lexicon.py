"""Word lists of the name and place rules.

Lists of closed classes are fixed values. Names, places and place adjectives are open classes: the defaults here are
short lists of common ones and rules that derive forms; a fuller register is a parameter (``Lexicon.with_words`` or a
text file with one word a line).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from pathlib import Path


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Words of institutions and documents, which are no names.
INSTITUTION = _words("""
sąd sądu trybunał trybunału izba kodeks kodeksu ustawa ustawie prawo prawa ordynacja rozporządzenie urząd urzędu
ministerstwo sejm senat parlament komisja inspekcja straż policja prokuratura rzecznik cywilny cywilnego karny karnego
pracy handlowy administracyjny postępowania wykonawczy skarbowy rzeczpospolita polska polski unia europejska najwyższy
apelacyjny okręgowy rejonowy konstytucyjny państwowa narodowy narodowa fundusz zakład krajowy krajowa główny główna
społecznych umowa umowie załącznik rozdział artykuł ustęp punkt pozycja faktura pismo wniosek decyzja departament biuro
wydział referat oddział sekcja nowy nowa uniwersytet uniwersytetu politechnika akademia akademii instytut instytutu
bank banku szpital szpitala teatr muzeum klub związek związku kancelaria kancelarii fundacja fundacji stowarzyszenie
spółka spółki spółdzielnia spółdzielni samorząd samorządu rada rady zarząd zarządu gmina gminy powiat powiatu
województwo starostwo kuratorium izby komitet komitetu hufiec zespół zespołu koło zrzeszenie komenda komendy ośrodek
ośrodka funduszu centrum agencja agencji dyrekcja dyrekcji park parku
""")
# Titles before a name.
TITLES = _words("pan pani pana panu panią panie państwo szanowny szanowna dr prof mgr inż")
# Roles before a name, which stay.
ROLES = _words("""
prezes prezesa prezesie dyrektor dyrektora dyrektorze minister ministra prezydent prezydenta wiceprezes wicedyrektor
wojewoda wojewody starosta starosty burmistrz burmistrza wójt wójta marszałek marszałka sędzia sędziego sędzię
prokurator prokuratora adwokat adwokata radca radcy notariusz notariusza komornik komornika kierownik kierownika
naczelnik naczelnika inspektor inspektora kurator kuratora rektor rektora dziekan dziekana profesor profesora doktor
doktora mecenas mecenasa kanclerz przewodniczący przewodnicząca sekretarz skarbnik pełnomocnik biegły świadek powód
pozwany oskarżony wnioskodawca pracownik pracownica klient klientka pacjent pacjentka najemca wynajmujący właściciel
właścicielka dłużnik wierzyciel kupujący sprzedający zleceniodawca zleceniobiorca wykonawca zamawiający konsument
ubezpieczony poszkodowany uczestnik członek przedstawiciel abonent użytkownik nabywca darczyńca piekarnia tartak
gospodarstwo warsztat hurtownia sklep apteka przychodnia restauracja pracownia przedsiębiorstwo usługowy usługowa
usługowe handlowy handlowa handlowe produkcyjny produkcyjna rolny rolna rolne transportowy budowlany budowlana
wielobranżowy
""")
# What stands before names in capitals besides.
CAPITAL_TITLES = TITLES | ROLES | _words("panem panów panom panami paniom sso ssr ssa mec adw")
# A surname after one of these names a thing or a place.
NOT_A_PERSON_AFTER = _words("""
choroba chorobę choroby chorobą chorobie objaw objawu objawy objawie zespół zespołu zespole syndrom syndromu próba
próbę próby odczyn odczynu test testu testem skala skali skalę metoda metodę metody metodą prawo prawa twierdzenie
zasada zasadę reguła reakcja klasyfikacja punkt ulica ulicy ulicę ulicą ulic aleja alei aleję aleją plac placu placem
placa rondo ronda most mostu mostem osiedle osiedla osiedlu dzielnica dzielnicy dzielnicę park parku skwer bulwar
powiat powiatu powiecie powiatem gmina gminy gminie gminą województwo województwa województwie
""")
# Surnames that are common nouns.
HOMOGRAPHS = _words("""
mazur mazurek zając baran wilk lis kot kruk sowa mucha wrona sroka czajka gołąb dudek wróbel sikora kania szczygieł
skowronek orzeł kaczor piątek sobota niedziela środa kwiecień maj marzec styczeń grudzień lipiec sierpień król kowal
rybak krawiec cieśla sołtys turek czech niemiec prus cygan góral polak socha skiba krupa paluch noga żyła duda bąk mróz
rak ptak drozd okoń szpak pająk motyl żuk chmiel kalina jagoda gruszka żak kurek sitek gajda jarosz marek bober
przybysz dziedzic mroczek starosta
""")
# Nouns that open sentences of letters and rulings.
COMMON_NOUNS = _words("""
sprawa sprawie sprawy sprawą sprawozdanie postanowienie postanowieniu rozpoznanie uzasadnienie oświadczenie
zawiadomienie wezwanie wezwaniu orzeczenie odwołanie zażalenie skarga skargę skargi protokół protokole notatka notatkę
notatki pełnomocnictwo upoważnienie zaświadczenie potwierdzenie zgłoszenie rozstrzygnięcie zarządzenie kotłownia
""")
# Given names that pair by a hyphen.
FOREIGN_GIVEN = _words("""
jean pierre paul marie anne claude luc marc jacques michel andre andré louis henri francois françois rené rene yves
hans karl heinz klaus peter ernst fritz dieter uwe kurt otto rolf wolf horst jurgen jürgen john james david michael
mary sarah kevin jose josé juan carlos luis pedro miguel diego pablo ana maria luigi giovanni marco ali ahmed mohamed
muhammad omar hassan ibrahim mustafa abdul kim lee chen wang li minh thi anh van duc thu erik lars sven nils per ola
""")
# Fields left empty, and the words that form labels begin with.
EMPTY_VALUES = frozenset(["brak", "niedotyczy", "nd", "n/d", "bd", "x", "bez", ".", "-", "–", "—", "", "nieznane", "nieznana", "nieznany", "niepodano", "niepodane"])
LABEL_WORDS = _words("""
nazwisko nazwiska imię imiona imie data miejsce miejscowość ulica nr numer kraj województwo powiat gmina kod pesel nip
regon krs telefon tel email e-mail adres rozpoznanie oddział jednostka wydział dział stanowisko zawód wykształcenie
obywatelstwo seria dokument płeć stan dane rozdział załącznik punkt pozycja poz specjalność tytuł nazwa firma
""")
# Codes before amounts.
CURRENCIES = frozenset("PLN EUR USD GBP CHF CZK SEK NOK DKK JPY UAH RUB".split())
# First letters of number plates.
PLATE_LETTERS = frozenset("BCDEFGHKLNOPRSTUWZ")
# Places of several words.
LONG_PLACES = frozenset(x.strip() for x in """
nowy sącz|nowy targ|nowy dwór mazowiecki|nowy dwór gdański|nowy wiśnicz|nowy żmigród|nowe miasto lubawskie|
nowe miasto nad pilicą|nowe miasto nad wartą|nowa sól|nowa ruda|nowa dęba|nowa słupia|stary sącz|zielona góra|
jelenia góra|kamienna góra|góra kalwaria|góra śląska|dąbrowa górnicza|dąbrowa tarnowska|dąbrowa białostocka|
ruda śląska|stalowa wola|ostrów wielkopolski|ostrów mazowiecka|ostrowiec świętokrzyski|biała podlaska|biała rawska|
bielsko biała|wysokie mazowieckie|grodzisk mazowiecki|grodzisk wielkopolski|tomaszów mazowiecki|tomaszów lubelski|
piotrków trybunalski|rawa mazowiecka|sokołów podlaski|wodzisław śląski|aleksandrów kujawski|aleksandrów łódzki|
konstantynów łódzki|gorzów wielkopolski|górowo iławeckie|szklarska poręba|bystrzyca kłodzka|nowogród bobrzański|
maków mazowiecki|maków podhalański|mińsk mazowiecki|kostrzyn nad odrą|miejska górka|tarnowskie góry|
czerwionka leszczyny|sępólno krajeńskie|solec kujawski|środa wielkopolska|środa śląska|oborniki śląskie|brzeg dolny|
skarżysko kamienna|murowana goślina|miasteczko śląskie|ożarów mazowiecki|kędzierzyn koźle|duszniki zdrój|kudowa zdrój|
polanica zdrój|lądek zdrój|busko zdrój|rabka zdrój|iwonicz zdrój|konstancin jeziorna|jastrzębie zdrój|
goczałkowice zdrój|połczyn zdrój|świeradów zdrój
""".split("|"))

# Defaults of the open classes.
_PLACES = """
warszawa warszawie warszawy kraków krakowie krakowa łódź łodzi wrocław wrocławiu wrocławia poznań poznaniu poznania
gdańsk gdańsku gdańska szczecin szczecinie bydgoszcz bydgoszczy lublin lublinie białystok białymstoku katowice
katowicach gdynia gdyni częstochowa częstochowie radom radomiu sosnowiec sosnowcu toruń toruniu kielce kielcach
rzeszów rzeszowie gliwice gliwicach zabrze zabrzu olsztyn olsztynie bytom bytomiu rybnik rybniku opole opolu tychy
tychach elbląg elblągu płock płocku wałbrzych wałbrzychu włocławek włocławku tarnów tarnowie chorzów chorzowie
koszalin koszalinie kalisz kaliszu legnica legnicy grudziądz słupsk słupsku konin piła pile suwałki suwałkach gniezno
gnieźnie leszno lesznie zamość zamościu pruszków pruszkowie łomża łomży chełm przemyśl przemyślu siedlce siedlcach
sopot sopocie zakopane zakopanem puławy sanok krosno cieszyn bielsko-biała bielsku-białej kędzierzyn-koźle
"""
_MALE_NAMES = """
adam adrian aleksander andrzej antoni arkadiusz artur bartłomiej bartosz bogdan bogusław cezary daniel dariusz dawid
dominik edward emil filip franciszek gabriel grzegorz henryk hubert igor jacek jakub jan janusz jarosław jerzy józef
julian kacper kamil karol kazimierz konrad krzysztof leszek łukasz maciej marcin marek mariusz mateusz michał
mieczysław mikołaj mirosław norbert oskar patryk paweł piotr przemysław radosław rafał robert roman ryszard sebastian
sławomir stanisław stefan szymon tadeusz tomasz waldemar wiesław wiktor witold władysław włodzimierz wojciech zbigniew
zdzisław zygmunt
"""
_MORE_MALE_NAMES = """
bronisław czesław edmund eugeniusz fryderyk gerard gustaw ignacy ireneusz jeremi kajetan kornel krystian lech leon
leonard ludwik marcel maksymilian mirosław oskar olaf seweryn tymoteusz wacław wincenty witalis zenon
janek jurek darek sławek mirek romek stasiek franek kuba
"""
_MORE_FEMALE_NAMES = """
aneta bernadetta blanka cecylia daria edyta eugenia felicja iza kornelia lena liliana łucja marzena milena nina nadia
olga otylia pola regina roksana róża sabina sandra violetta żaneta
kaśka zosia hania madzia renia krysia jola ela
"""
_FEMALE_NAMES = """
agata agnieszka aleksandra alicja anna antonina barbara beata bożena celina danuta dominika dorota elżbieta emilia ewa
ewelina gabriela genowefa grażyna halina hanna helena irena iwona izabela jadwiga janina joanna jolanta julia justyna
kamila karolina katarzyna kinga klaudia krystyna lidia lucyna magdalena maja małgorzata maria marianna mariola marta
martyna monika natalia oliwia patrycja paulina renata sylwia stanisława stefania teresa urszula wanda weronika wiesława
wiktoria zofia zuzanna kasia basia ania asia gosia ola tomek bartek krzysiek pamela
"""
_SURNAMES = """
nowak kowalski wiśniewski wójcik kowalczyk kamiński lewandowski zieliński szymański woźniak dąbrowski kozłowski
jankowski mazurkiewicz wojciechowski kwiatkowski krawczyk kaczmarek piotrowski grabowski zając pawłowski michalski
nowakowski adamczyk dudek zawadzki wieczorek jabłoński wróblewski majewski olszewski stępień malinowski jaworski
pawlak witkowski walczak rutkowski sikorski baranowski michalak szewczyk ostrowski tomaszewski pietrzak marciniak
wysocki zalewski jakubowski jasiński sadowski bąkowski chmielewski włodarczyk borkowski czarnecki sawicki sokołowski
urbański kubiak maciejewski szczepański kucharski wilczyński kalinowski lis wasilewski górski kołodziej cieślak
sobczak głowacki ziółkowski andrzejewski kaźmierczak błaszczyk czerwiński laskowski makowski przybylski gajewski
gołębiowski krajewski szulc baran brzeziński wojtas mróz kozieł banaś pietrzyk gawron sroka urban bielecki janik
szczygieł konieczny marcinkowski markowski kurek stankiewicz leśniak bednarek bednarz domański lipiński
"""
# Stems of given names and trades, and what makes family names of them.
_FAMILY_STEMS = """
adam andrzej antoni bart bartosz błaż dawid dom filip franc gabry ign jakub jan janus jas jędrzej józef kacper karol
kazimier klim konrad kub lew łuk mac marc mat mich mikołaj mroz olej paw piotr roman sob stan stef szczep szym tom urban
walent was wit wojciech zyg kowal młynar szew bedn krawc woźn piek
"""
_FAMILY_ENDINGS = "ak czak czyk iak icki ik owicz ewicz owski ewski iński niak"
_MORE_SURNAMES = """
adamus bakuła banach bielak bilski bogusz borowski buczek budzyński cebula chojnacki cichocki cybulski czapla czarnecki
dębski dobosz drozdowski dziuba fijałkowski filipek frankowski gołębiewski górecki graczyk guzik hajduk jagiełło jaros
kasprzak kempa kędzierski klimek kłos kopeć kosiński kot kowalewski kozioł kozak królikowski kruszewski kulesza kurowski
leszczyński lisowski łukasik madej maliszewski matuszewski mikulski milewski molenda morawski murawski nowacki nowicki
orłowski osiński owczarek pawelec piasecki polański przybysz rogowski rosiński różański rybicki sienkiewicz skibiński
skrzypczak sobolewski socha stachowiak stasiak stelmach stolarczyk szostak śliwiński świątek święcicki tkaczyk
turowski wolański wolski wrona wrzesiński zaremba zaręba zawada ziemba żak żurawski żukowski
"""


def families() -> frozenset[str]:
    """Family names made from stems and endings."""
    return frozenset(stem + ending for stem in _FAMILY_STEMS.split() for ending in _FAMILY_ENDINGS.split())


# Endings of towns' names and what makes adjectives of them, the longest that fits first.
_TOWN_ENDINGS = """
awek awski|szcz ski|ielce ielecki|dlce dlecki|ańsk ański|ica icki|ice icki|iec iecki|awa awski|owa owski|nia ński|ław ławski|dź dzki|dz dzki|sk ski|ck cki|ów owski
ań ański|uń uński|in iński|yn yński|om omski|ąg ąski|ch ski|sz ski|ik icki|ok ocki|le lski
"""
# Adjectives of countries and peoples, of regions, and of estates and trades, by letter.
_COUNTRY_ADJECTIVES = """
afrykański amerykański angielski arabski australijski austriacki azjatycki belgijski białoruski brazylijski brytyjski bułgarski chiński chorwacki czeski
duński egipski estoński europejski fiński francuski grecki hiszpański holenderski indyjski irlandzki izraelski japoński kanadyjski koreański litewski
łotewski meksykański niemiecki norweski polski portugalski rosyjski rumuński serbski słowacki słoweński szkocki szwajcarski szwedzki turecki ukraiński
węgierski wietnamski włoski żydowski
"""
_REGION_ADJECTIVES = """
białostocki dolnośląski kujawski lubelski lubuski łódzki małopolski mazowiecki mazurski nowosądecki opolski otwocki podhalański podkarpacki podlaski
pomorski śląski świętokrzyski warmiński wielkopolski wołomiński zachodniopomorski
"""
_OTHER_ADJECTIVES = """
adwokacki akademicki boski damski gospodarski górniczy królewski książęcy lekarski lotniczy ludzki męski miejski morski pielęgniarski rolniczy rycerski
studencki szlachecki unijny wiejski wojskowy
"""


def of_towns(places: frozenset[str]) -> frozenset[str]:
    """Adjectives made of towns' names by their endings."""
    rules = sorted((tuple(rule.split()) for line in _TOWN_ENDINGS.strip().split("\n") for rule in line.split("|")), key=lambda r: -len(r[0]))
    made = (next((p[: -len(end)] + to for end, to in rules if p.endswith(end)), None) for p in places if " " not in p)
    return frozenset(m for m in made if m)


def _feminine() -> frozenset[str]:
    """Given names of women made of those of men, as Stanisława of Stanisław."""
    return frozenset(n + "a" for n in (_MALE_NAMES + _MORE_MALE_NAMES).split() if n.endswith(("sław", "mir")))


@dataclass(frozen=True)
class Lexicon:
    first_names: frozenset[str] = field(default_factory=lambda: _words(_MALE_NAMES + _FEMALE_NAMES + _MORE_MALE_NAMES + _MORE_FEMALE_NAMES) | _feminine())
    surnames: frozenset[str] = field(default_factory=lambda: (_words(_SURNAMES + _MORE_SURNAMES) | families()) - HOMOGRAPHS - _words(_MALE_NAMES + _MORE_MALE_NAMES))
    places: frozenset[str] = field(default_factory=lambda: _words(_PLACES) | LONG_PLACES)
    place_adjectives: frozenset[str] = field(default_factory=lambda: of_towns(_words(_PLACES)) | _words(_COUNTRY_ADJECTIVES + _REGION_ADJECTIVES + _OTHER_ADJECTIVES))

    def with_words(self, **more) -> Lexicon:
        """This lexicon with words added to its lists; a list is given as words or as the path of a file."""
        read = lambda x: Path(x).read_text(encoding="utf-8").split("\n") if isinstance(x, (str, Path)) else x
        return replace(self, **{k: getattr(self, k) | {w.strip().lower() for w in read(v) if w.strip()} for k, v in more.items()})

    @cached_property
    def name_stems(self) -> frozenset[str]:
        return frozenset(n.removesuffix("a") for n in self.first_names)


DEFAULT = Lexicon()
