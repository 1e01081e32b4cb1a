"""Texts that the tagger learns from besides the tables: frames of everyday sentences, filled with names and numbers.

Names come from short lists of common given and family names and from rules that build further ones from syllables, so that
the tagger meets a new name nearly every time and has to read what stands around it. The same frames hold places, works,
ensembles and devices in capitals, often built on family names, which are no persons.
"""

from __future__ import annotations

import numpy as np
import regex as re

from .crf_tagger import KINDS

GIVEN = (
    "Anna Lucas Maria James Heike Wei Samuel Sofia Peter Emma Noah Olivia Liam Ava Mia Elias Hannah Jonas Lea Paul Clara Felix Marie Max Julia Tim Laura Jan Nina Tobias Sabine Klaus Ursula Jürgen Birgit Thomas Stefan Petra Hans Greta Luis Carmen "
    "José Ana Miguel Lucía Pablo Elena Javier Marta Diego Isabel Carlos Rosa Antonio Pilar Jean Pierre Camille Léa Hugo Manon Louis Chloé Jules Sophie Luc Claire Henri Margaux Éric Nathalie Michel Brigitte Yusuf Fatima Ahmed Leila Omar Aisha Ali "
    "Noor Priya Arjun Ravi Anjali Sanjay Meera Mei Jun Ling Hiro Yuki Kenji Sakura Min Ji Kwame Ama Chidi Ngozi Olga Ivan Natasha Dmitri Katya Pavel Zofia Jakub Agnieszka Piotr Ilona Bence Lars Ingrid Sven Astrid Erik Freja Mats Aino Eero "
    "Giulia Marco Chiara Luca Paolo Francesca George Margaret William Grace Henry Alice Edward Rose Arthur Ruby Walter Daisy Frank Joan Keith Linda Robert Susan David Karen John Mary Michael Sarah Daniel Ruth Simon Helen Andrew Kate Mark Jane Ben"
).split()
GIVEN_2 = (
    "Abigail Adrian Agnes Albert Alexander Alfred Amanda Amelia Andrea Angela Annette Anthony Archie Audrey Barry Beatrice Belinda Bernard Beryl Bianca Boris Brenda Brian Bruce Bryan Cameron Candice Caroline Catherine Cecil Celia Charles Charlotte Christine Christopher Clarence "
    "Claudia Colin Cornelia Craig Crispin Cynthia Damian Deborah Dennis Derek Diana Donald Doris Dorothy Douglas Duncan Edith Edmund Edwin Eileen Eleanor Elizabeth Ellen Elsa Enid Eric Ernest Esther Ethel Eugene Eva Evelyn Fabian Fiona Flora Florence Francis Frederick Gail "
    "Gavin Geoffrey Gerald Gilbert Gina Glenn Gloria Gordon Graham Gregory Guy Gwen Harold Harriet Hazel Hector Herbert Hilda Horace Howard Hubert Ian Irene Iris Isaac Ivy Jack Jacqueline Janet Jason Jasmine Jeffrey Jennifer Jeremy Jessica Jill Joel Jonathan Joseph Josephine Joyce "
    "Judith Justin Kenneth Kevin Lawrence Leonard Leslie Lillian Lionel Lloyd Lorraine Louise Lucinda Lydia Malcolm Marcus Marion Martha Maureen Maurice Maxwell Melanie Mildred Miles Molly Monica Muriel Nadia Nathan Neil Nicholas Nicola Nigel Nora Norman Oliver Oscar"
).split()
GIVEN_3 = (
    "Pamela Patricia Patrick Pauline Penelope Percy Philip Phoebe Phyllis Quentin Rachel Ralph Raymond Rebecca Regina Reginald Richard Roderick Roger Roland Ronald Rosalind Rosemary Roy Rufus Rupert Russell Sabrina Sally Samantha Sebastian Selina Shane Sharon Sheila Shirley Sidney "
    "Stanley Stella Stewart Stuart Sylvia Tabitha Tamara Teresa Terence Tessa Theodore Tracy Trevor Tristan Valerie Vanessa Vera Vernon Veronica Victor Victoria Vincent Viola Violet Virginia Vivian Wallace Wanda Warren Wendy Wesley Wilfred Winifred Yvonne Zachary Zoe "
    "Adele Alain Alexandre Amélie Antoine Aurélie Bastien Benoît Cécile Corinne Didier Édith Élodie Fabrice Florian Gaston Gérard Ghislaine Hélène Jacques Joëlle Laurence Mathilde Maxime Olivier Pascal Quentin Romain Sylvain Thérèse Valentin Xavier Yves "
    "Alberto Alejandro Amparo Beatriz Bruno Catalina Concepción Cristina Dolores Enrique Esteban Eduardo Fernando Francisco Gabriela Gonzalo Guillermo Ignacio Inés Joaquín Jorge Lorenzo Manuel Mercedes Nuria Ramón Raúl Ricardo Rocío Rodrigo Salvador Tomás Vicente Ximena"
).split()
GIVEN_4 = (
    "Alexandra Andreas Anke Anneliese Annika Bastian Bettina Christoph Claudia Detlef Dieter Dörte Eckhard Elke Elfriede Erika Ernst Ferdinand Franziska Friedrich Gabriele Georg Gerhard Gisela Gudrun Günther Gustav Hartmut Helga Helmut Holger Horst Inge Irmgard Jochen Johannes Jutta Karin "
    "Katharina Konrad Kurt Leonie Liselotte Lothar Manfred Margarete Marlene Matthias Monika Norbert Oskar Otto Renate Rolf Rudolf Siegfried Silke Svenja Thorsten Ulrich Ute Volker Waltraud Werner Wolfgang "
    "Abdul Adebayo Akira Amara Amina Anil Aryan Asha Ayşe Babak Chen Daisuke Deepak Dong Emeka Farah Folake Gamal Goran Haruki Hassan Hiroshi Imran Ismail Jamal Javed Karim Keiko Khalid Kofi Kwabena Lakshmi Mahmoud Malik Manish Mehmet Mohammed Nadeem Naoki Neha Nikhil Obinna Oksana "
    "Pooja Rahul Rashid Ren Sadia Samir Sanjana Sergei Shreya Sunil Svetlana Takashi Tariq Tatiana Tendai Usman Vikram Vladimir Xin Yasmin Youssef Yuri Zainab Zoltan"
).split()
FAMILY_2 = (
    "Abbott Acton Adair Ainsley Alcott Aldridge Allen Anderson Archer Arnold Ashworth Atkinson Austin Bailey Baldwin Ballard Barber Barlow Barnes Barrett Barton Bates Baxter Beck Bennett Benson Berry Bishop Blackwood Blake Bolton Bond Booth Bowen Bradshaw Brewer Briggs Brooks Bryant Buckley "
    "Burgess Burke Burns Burton Butler Byrne Calder Caldwell Campbell Carroll Carson Carter Carver Chambers Chandler Chapman Chase Clay Cohen Coleman Collins Connor Conway Cook Crane Crawford Cross Cunningham Curtis Dalton Daniels Dawson Dean Denton Dixon Donovan Doyle Drake Dudley Duncan Dunn "
    "Eaton Elliott Ellis Farrell Fenwick Ferguson Finch Fleming Fletcher Flynn Foster Fowler Fox Franklin Frost Gallagher Gardner Garrison Gibson Gilbert Glover Goddard Goldberg Goodwin Grant Graves Gray Gregory Griffith Hadley Hale Hammond Hardy Harper Harrington Hartley Harvey Hawkins Hayes Heath "
    "Henderson Holland Holmes Hooper Hopkins Howard Hudson Humphrey Hunt Hutchinson Irving Jarvis Jenkins Jennings Kane Keating Kelly Kendall Kerr Knight Knox Lambert Lancaster"
).split()
FAMILY_3 = (
    "Lawson Leonard Lindsay Lloyd Lockhart Logan Lowe Lynch Maddox Manning Marlowe Marshall Maxwell Mercer Merritt Mitchell Monroe Morgan Morris Morrison Moss Murphy Murray Nash Newton Nicholson Norris Norton Oakley Osborne Owens Palmer Parker Parsons Partridge Paterson Payne Pearce Pembroke Perkins "
    "Perry Phillips Pike Pitt Porter Powell Pratt Preston Price Quinn Radcliffe Ramsay Randall Reeves Reynolds Rhodes Richards Riley Robinson Rogers Rowe Russell Ryan Sanders Sawyer Saunders Sexton Shaw Shepherd Sherwood Sinclair Slater Spencer Stafford Stanton Stephens Stewart Sullivan Sutton Swift "
    "Sykes Talbot Tate Temple Thornton Todd Tucker Underwood Vane Vaughan Vincent Wade Wallace Walsh Walton Warner Watkins Watson Watts Webb Wells West Wheeler Whitaker Wilcox Wilkins Winters Wolfe Woodward Yates York "
    "Abdullah Adeyemi Aguilar Ahmed Aziz Banerjee Bauer Becerra Benítez Bergmann Bjornsson Chaudhry Cortés Delgado Desai Dietrich Ebner Escobar Farouk Ferreira Fuentes Gallo Haddad Hakimi Hashimoto Iyer Jansen Kaplan Keita Kobayashi Lehmann Lindqvist Mbeki Menon Mishra Mori Nakamura Nkosi Okonkwo "
    "Popescu Rahman Reddy Sarr Schreiber Sokolov Solberg Takahashi Ueda Vasquez Vogt Winkler Yilmaz Zielinski"
).split()
FAMILY = (
    "Hall Meyer Gates Zimmermann Zhang Smith Johnson Brown Taylor Wilson Davies Evans Thomas Roberts Walker Wright Thompson White Hughes Edwards Green Wood Harris Lewis Martin Jackson Clarke Turner Hill Cooper Ward Moore Lee King Baker Street Lane Harbour "
    "Gate Field Brook Stone Rivers Banks Bridges Parks Church Mills Ford Bell Reed Horn Marsh Pond Fields Drummer Carpenter Fisher Mason Miller Potter Weaver Müller Schmidt Schneider Fischer Weber Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf "
    "Schröder Neumann Schwarz Krüger Hartmann Lange Krause Vogel García Martínez López Sánchez Pérez Gómez Fernández Ruiz Díaz Moreno Álvarez Romero Torres Navarro Ramos Castro Ortega Dubois Durand Moreau Laurent Simon Michel Lefebvre Leroy Roux David "
    "Bertrand Morel Fournier Girard Bonnet Rossi Russo Ferrari Bianchi Ricci Marino Greco Conti Costa Silva Santos Oliveira Pereira Almeida Nguyen Tran Pham Kim Park Choi Wang Chen Liu Yang Huang Zhao Wu Tanaka Suzuki Sato Yamamoto Ito Khan Patel Singh "
    "Sharma Gupta Kumar Das Okafor Mensah Diallo Traoré Ivanov Petrov Novak Kowalski Nowak Horvath Nagy Andersson Johansson Nilsson Hansen Olsen Larsen Virtanen O'Brien O'Neill MacDonald McCarthy"
).split()
_GIVEN_A = "Al Be Ca Da El Fa Gi Ha Il Jo Ka Lo Ma Ne Or Pa Quin Ro Sa Te Ul Vi Wil Ya Zo Thea Bran Cris Fre Ste Mor Lin Sel".split()
_GIVEN_B = "na ra rie lin mar bert ton vio la sa ric mond fred gar trud lia nor wen dre ko mi da ley son nie ette is o a en ina ola ian el in us ma ron ica mir".split()
_FAMILY_A = "Thorn Hart Black Ash Stein Rosen Linden Kirch Ober Nieder Win Har Bar Lang Mor Cald Whit Brad Hol Pen Tre Car Dun Kin Mac Fitz Gold Silver Berg Lund Nor Vester Pol Kov Mar Del Val Mont Bel Cas Ros Gar Star Cor Hel".split()
_FAMILY_B = "bury ton ford ham wood ley field worth son man mann berg stein feld bach hoff ski sky ov enko ez ini etti elli ard eau ault ier in ell er ing well ridge shaw wick den strom qvist sen oza ano ado ow by".split()
_TITLES = ["Mr. ", "Mrs. ", "Ms ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Mme ", "Sr. ", "Sra. ", "Miss ", "Sir "]
_PARTICLES = ["van ", "von ", "de ", "de la ", "van der ", "del ", "di ", "al "]
_STREETS = "Mill Church High Station Park Oak Elm Baker Victoria Queens King Chapel North Bridge Garden Cedar Maple Castle Abbey Orchard".split()
_FIRST = (
    "North South Old New Grand Royal Central Silver Golden Silent Blue Red Black White Green Stone River Winter Summer Iron Crystal Lucky Hidden Electric Midnight Mountain Forest Harvest Falcon Raven Atlas Orion Nova Vega Delta Omega"
).split()
_PLACES = "Hall Street Road Lane Park Bridge Station Tower Museum Island Harbour Quay Library Hospital Gallery Theatre Arena Square Valley Bay Lake Hill Point Castle School College Airport Market Gardens Pier Gate Cathedral Forest Beach Cinema Stadium Terminal Crossing Meadow Farm Lighthouse Monument Mall Plaza Kitchen Bakery Springs Falls".split()
_THINGS = "Camera Printer Engine Router Mixer Drive Mark Pro Max Turbo Tractor Scanner Piano Guitar Console Phone Watch Monitor Server Browser Recorder Lamp Kettle Bicycle Amplifier Toaster Ten Nine Hundred Series Kit Sensor Pedal Keyboard Speaker Laptop Heater".split()
_WORKS = "River Garden Letters Dreams Morning Machine Horizon Lanterns Sonata Waltz Blues Suite Journey Stories Empire Shadows Nocturne Symphony Voyage Promises Windows Secrets Highway Fever Kingdom Rain Lullaby Anthem Prelude Chronicles Nights Mountains".split()
_GROUPS = "Quartet Trio Orchestra Ensemble Institute Bank Foundation Records Choir Band Partners Brothers Company Press University Society Collective Airlines Hotel Group United Rovers".split()
_WORDS = (
    "report window garden meeting ticket letter kitchen engine project schedule budget lecture recording chapter parcel invoice concert lesson draft harvest bicycle camera contract summer station bridge river market doctor teacher driver manager baker painter neighbour colleague "
    "violin drum coffee bread table morning evening Monday Friday weekend winter server database release test backup network keyboard screen manual version folder file version museum library train flight hotel airport recipe soup cake salad cheese football match team coach goal stadium"
).split()
_VERBS = "called wrote visited finished repaired opened signed missed checked described bought sold moved built cleaned planned joined left found lost painted tested printed translated delivered ordered reviewed reported explained recorded borrowed returned".split()

# {N} a person, {M} another, {P} a place, {T} a device, {W} a work, {G} a group, {w} a word, {v} a verb, {d} a number, {E} email, {F} phone, {I} labelled number, {A} address
PERSON = [
    "{N} {v} the {w} before the {w} closed.", "Yesterday {N} {v} our {w} at {P}.", "The {w} was {v} by {N}.", "I spoke with {N} about the {w}.", "Please tell {N} that the {w} is ready.", "{N} and {M} {v} the {w} together.", "According to {N}, the {w} needs another {w}.",
    "We hired {N} as a {w} last year.", "My {w}, {N}, lives near {P}.", "{N} said the {w} would be late.", "Has {N} {v} the {w} yet?", "Thank you, {N}, for the {w}.", "The {w} belongs to {N}.", "Nobody knew why {N} {v} the {w}.", "{N}'s {w} was {v} on Friday.", "When {N} arrived, the {w} had started.",
    "A letter from {N} reached us on {d} May.", "{N} won the {w} and {M} came second.", "In {d}, {N} moved to {P}.", "Minutes taken by {N}; chaired by {M}.", "Present: {N}, {M}, {N}.", "Author: {N}", "Name: {N}\nPhone: {F}", "Contact {N} at {E} or {F}.", "From: {N} <{E}>", "\"{N}\" <{E}> wrote:",
    "Dear {N},\nthe {w} is attached.", "Regards,\n{N}\n{A}", "-- \n{N}\n{A}\nTel. {F}", "{N}, who {v} the {w}, is {d} years old.", "It is said that {N} {v} the first {w}.", "The witness, {N}, {v} a {w} outside {P}.", "Patient {N} was seen on {d} March.", "Our teacher {N} {v} the {w} with {M}.",
    "They asked {N} to bring the {w}.", "Without {N} the {w} fails.", "{N} plays for {G}.", "{N} recorded {W} with {G} at {P}.", "Is {N} still working on the {w}?", "cc {N}, {M}", "user: {N}; tel: {F}; home: {A};", "user {N} ({I})", "{N} ({E}) {v} it.", "Signed: {N}", "Photo by {N}.", "Invite {N} or {M}.", "Meet {N} in front of {P}.",
    "{N} lent the {T} to {M}.", "{N} has the passport details: {I}.", "Then came {N} with a {w} under one arm.", "the {w} was for {N}, not for {M}.", "Somebody called {N} {v} the {w}.", "We met {N} at the {w}.", "{N} told me that {M} {v} it.", "Born in {P}, {N} studied in {P}.",
    "Gestern hat {N} den Brief geschrieben.", "{N} wohnt in der {A}.", "Bitte fragen Sie {N} nach dem Termin.", "Laut {N} ist der Zug verspätet.", "Mit {N} und {M} haben wir lange gesprochen.", "Der Arzt {N} kommt aus {P}.", "Viele Grüße\n{N}\n{A}", "Das Auto von {N} steht vor dem Haus.", "Heute spielt {N} mit {G}.", "Von {N} habe ich nichts gehört.",
    "Hier, {N} a réparé la voiture.", "Selon {N}, le train est en retard.", "Nous avons dîné avec {N} et {M}.", "{N} habite au {A}.", "Merci à {N} pour le livre.", "Le livre de {N} est sorti en {d}.", "Cordialement,\n{N}\n{F}", "La lettre est pour {N}.", "C'est {N} qui a téléphoné.",
    "Ayer {N} compró una casa en {P}.", "Según {N}, el tren llega tarde.", "Hablamos con {N} y {M}.", "{N} vive en {A}.", "Gracias a {N} por el libro.", "El libro de {N} salió en {d}.", "Saludos,\n{N}\n{F}", "Pregunta por {N} en la tienda.", "La carta es para {N}.",
]
OTHER = [
    "Write to {E} before noon.", "Our office is at {A}.", "You can reach the desk on {F}.", "{I}, issued in {d}.", "Call {F} or write to {E}.", "Ship the {w} to {A}, please.", "The form asks for {I}.", "Send it to {A} and mail {E}.", "My {I}, thanks.", "Reach me under {F} after {d}.", "He moved to {A} in {d}.", "Mi número es {F}.", "Meine Nummer ist {F}.",
    "Mon adresse: {A}", "Unsere Anschrift lautet {A}.", "Vivo en {A}.", "E-mail: {E}\nTel: {F}", "Der {I} liegt vor.", "she gave {I} at the counter",
]
NOBODY = [
    "We {v} the {w} at {P}.", "The {T} needs a new {w}.", "The {T} weighs {d} grams.", "{W} was {v} in {d}.", "{G} {v} the {w} at {P}.", "From {P} it is {d} miles to {P}.", "The {P} line opened in {d}.", "Have you heard {W} by {G}?", "Order {d} of the {T} today.", "On the {T}, {W} sounds better.", "At {P}, the {w} {v} slowly.", "Meet us at {P} on Monday.",
    "Page {d} of {W} is missing.", "Ticket {d} is closed, see version {d}.{d}.", "Serial number {d}-{d}, batch {d}.", "{P} and {P} are closed on Sunday.", "In the {w} of {P} we {v} a {w}.", "The {w} costs {d} euros at {P}.", "Error {d} in line {d}: the {w} was {v}.", "Part {d} of {W} is missing.", "Two {w}s and a {w} were {v} this week.", "Nobody {v} the {w} near {P}.",
    "The United States and New Zealand agreed.", "Happy New Year from {G}!", "Room {d}, {P}.", "Chapter {d}: {W}", "The {G} bus was late.", "Am {P} steigen viele um.", "Das {T} kostet {d} Euro.", "Der Zug nach {P} hält nicht in {P}.", "Devant {P}, il y a du monde.", "Le {T} est vendu {d} euros.", "Cerca de {P} hay mucha gente.", "El {T} cuesta {d} euros.",
    "Good Morning America starts at {d}.", "Good work. Then we {v} the {w}. After that came {W}.", "Use #{d} as a tag.", "The {w} of the {w} {v} nothing.", "Microsoft Windows and Visual Studio were {v}.", "Version {d} of {T} ships on Friday.", "Dear Sir or Madam, the {w} is late.", "{W}, {W} and {W} close the record.", "Nobody at {P} had read {W}.",
]


def person(g: np.random.Generator, extra: list[str] | None = None) -> str:
    """A name: listed or built, with or without title-free extras such as an initial, a particle or a double family name."""

    def given() -> str:
        if extra and g.random() < 0.3:
            return mixed(extra, g)
        pool = (GIVEN, GIVEN_2, GIVEN_3, GIVEN_4)[g.integers(4)]
        return str(pool[g.integers(len(pool))]) if g.random() < 0.7 else str(g.choice(_GIVEN_A)) + str(g.choice(_GIVEN_B))

    def family() -> str:
        if extra and g.random() < 0.3:
            return mixed(extra, g)
        pool = (FAMILY, FAMILY_2, FAMILY_3)[g.integers(3)]
        if (roll := g.random()) < 0.1:  # any word can be a family name
            return str(_WORDS[g.integers(len(_WORDS))]).capitalize()
        return str(pool[g.integers(len(pool))]) if roll < 0.7 else str(g.choice(_FAMILY_A)) + str(g.choice(_FAMILY_B))

    a, b = given(), family()
    roll = g.random()
    if roll < 0.06:
        b = b + "-" + family()
    elif roll < 0.12:
        b = str(g.choice(_PARTICLES)) + b
    if g.random() < 0.12:
        a = a[0] + "."
    elif g.random() < 0.08:
        a = a + " " + given()[0] + "."
    elif g.random() < 0.05:
        a = a + "-" + given()
    out = f"{b}, {a}" if g.random() < 0.08 else f"{a} {b}"
    roll = g.random()
    return out.lower() if roll < 0.06 else out.upper() if roll < 0.12 else out


def mixed(parts: list[str], g: np.random.Generator) -> str:
    """A part of mixed beginning and ending of two known ones."""
    a, b = parts[g.integers(len(parts))], parts[g.integers(len(parts))]
    return (a[: int(g.integers(2, 5))] + b[-int(g.integers(3, 6)) :]).capitalize()


def _digits(g: np.random.Generator, shape: str) -> str:
    letters = "ABCDEFGHJKLMNPRSTUVWXYZ"
    return "".join(str(g.integers(0, 10)) if c == "#" else str(g.integers(1, 10)) if c == "%" else letters[g.integers(len(letters))] if c == "@" else c for c in shape)


def _email(g) -> str:
    a, b = (re.sub(r"[^a-z]", "", person(g).lower()) or "ab" for _ in "12")
    local = g.choice([a[:8], f"{a[:5]}.{b[:6]}", f"{a[:1]}{b[:7]}", f"{a[:6]}_{g.integers(100)}", f"{a[:4]}+{b[:3]}"])
    host = f"{b[:7]}.{g.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'example.com', 'io'])}"
    form = g.choice(["{}@{}", "{}@{}", "{}@{}", "{} at {}", "{} [at] {}", "{}(at){}", "{} @ {}"])
    out = form.format(local, host.replace(".", " dot ") if form == "{} at {}" else host.replace(".", "[dot]") if form == "{} [at] {}" else host)
    return out.upper() if g.random() < 0.05 else out


def _phone(g) -> str:
    return _digits(g, str(g.choice(["(%##) ###-####", "%##-###-####", "+1 %## ### ####", "+44 20 #### ####", "020 7### ####", "+49 30 #######", "030 / ########", "0151 #######", "+33 % ## ## ## ##", "0% ## ## ## ##", "0%.##.##.##.##", "+34 6## ### ###", "6## ## ## ##", "07### ######", "+39 06 #### ####"])))


_ID_FORMS = [("SSN", "###-##-####"), ("Social Security number", "### ## ####"), ("National Insurance no.", "@@ ## ## ## @"), ("NINO", "@@######@"), ("tax id", "## ### ### ###"), ("Steuer-ID", "###########"), ("Steuer-IdNr.", "## ### ### ###"), ("passport", "@########"), ("passport number", "#########"), ("Passport No.", "@@#######"),
             ("Reisepass", "@########"), ("Personalausweis", "@########"), ("identity card", "#########"), ("DNI", "########-@"), ("NIE", "@#######@"), ("passeport", "##@@#####"), ("driving licence", "@###-####-####"), ("driver's license", "@#######"), ("Führerschein", "@##########"), ("carte d'identité", "############"), ("Sozialversicherungsnummer", "## ###### @ ###")]


def _labelled(g) -> tuple[str, str]:
    label, shape = _ID_FORMS[g.integers(len(_ID_FORMS))]
    return label + str(g.choice([" ", ": ", " is ", " no. ", ":", " = ", " #"])), _digits(g, shape)


def _address(g) -> str:
    n, s = int(g.integers(1, 300)), str(g.choice([*_STREETS, *FAMILY[:60]]))
    kind = g.integers(4)
    if kind == 0:
        return f"{n} {s} {g.choice(['Street', 'Road', 'Lane', 'Avenue', 'Close', 'Terrace', 'St.', 'Rd', 'Drive', 'Court', 'Way', 'Square'])}"
    if kind == 1:
        return f"{g.choice([s + 'straße', s + 'str.', s + 'weg', s + 'gasse', s + 'allee', 'Am ' + s, s + 'platz'])} {n}{g.choice(['', '', 'a', 'b'])}"
    if kind == 2:
        return f"{n}{g.choice(['', ',', ' bis'])} {g.choice(['rue', 'avenue', 'boulevard', 'quai', 'place', 'chemin'])} {g.choice(['', 'de ', 'du ', 'des '])}{s}"
    return f"{g.choice(['Calle', 'Avenida', 'Plaza', 'Paseo', 'C/'])} {g.choice(['', 'de ', 'del '])}{s}{g.choice([',', ''])} {g.choice(['', 'n.º '])}{n}"


def _slot(kind: str, g: np.random.Generator, extra: list[str] | None, ordinary: list[str] | None = None) -> tuple[str, str | None, str]:
    """(text before, kind of the span or None, text)."""
    if kind in "NM":
        return (str(g.choice(_TITLES)) if g.random() < 0.12 else ""), "name", person(g, extra)
    if kind == "E":
        return "", "email", _email(g)
    if kind == "F":
        return "", "phone", _phone(g)
    if kind == "I":
        label, number = _labelled(g)
        return label, "id_number", number
    if kind == "A":
        return "", "address", _address(g)
    first = lambda: str(g.choice((FAMILY, FAMILY_2, FAMILY_3)[g.integers(3)] if g.random() < 0.4 else _FIRST)) if g.random() < 0.9 else str(g.choice(_FAMILY_A)) + str(g.choice(_FAMILY_B))
    if kind == "P":
        return "", None, f"{first()} {g.choice(_PLACES)}"
    if kind == "T":
        return "", None, f"{first()} {g.choice(_THINGS)}"
    if kind == "W":
        return "", None, f"{g.choice(_FIRST)} {g.choice(_WORKS)}"
    if kind == "G":
        return "", None, f"{'the ' if g.random() < 0.3 else ''}{first()} {g.choice(_GROUPS)}"
    if kind == "C":  # ordinary words in capitals: a title or a brand
        pool = ordinary if ordinary and g.random() < 0.6 else _WORDS if g.random() < 0.5 else [*_FIRST, *_SMALL, *_PLACES, *_THINGS, *_WORKS]
        return "", None, " ".join(str(pool[g.integers(len(pool))]).capitalize() for _ in range(int(g.integers(2, 4))))
    if kind == "d":
        return "", None, str(g.integers(1, 10 ** int(g.integers(1, 9))))
    return "", None, str(g.choice(_WORDS if kind == "w" else _VERBS))


_SMALL = (
    "the a an this that every my your his her our their some no another we they she he it who what when where why how then now soon never always often still again only even just also until after before during behind beside under over with without from into near about for of by on at in to as than "
    "is was were has had will would could should may might can did does do be been and or but because if while though old new long short quiet heavy cheap early late kind young tired green broken warm cold next last first both two three four ten many few more most gave took went came saw said told "
    "asked knew made kept held paid sang ran walked drove read wrote taught met grew lives works hates likes wants needs speaks plays sings coughs smiles sleeps cooks paints teaches arrives leaves waits stays writes reads calls runs"
).split()


def loosened(frame: str, g: np.random.Generator, ordinary: list[str]) -> str:
    """The frame with words in small letters swapped for others, left out or added, so that no frame is ever met twice."""
    out = []
    for word in frame.split(" "):
        if re.fullmatch(r"\p{Ll}+[.,?!]?", word) and (roll := g.random()) < 0.65:
            if roll < 0.1:
                continue
            pool = _SMALL if roll < 0.35 else ordinary if ordinary and roll < 0.5 else _WORDS if roll < 0.58 else _VERBS
            word = str(pool[g.integers(len(pool))]) + (word[-1] if word[-1] in ".,?!" else "")
        out.append(word)
    return " ".join(out)


def scattered(g: np.random.Generator, ordinary: list[str]) -> str:
    """A frame of words without order, with a person, a place or the like anywhere among them."""
    words = []
    for _ in range(int(g.integers(3, 12))):
        pool = _SMALL if (roll := g.random()) < 0.55 else ordinary if ordinary and roll < 0.75 else _WORDS if roll < 0.9 else _VERBS
        words.append(str(pool[g.integers(len(pool))]))
    if g.random() < 0.7:
        words[0] = words[0].capitalize()
    for slot in g.choice(["N", "N", "N", "N", "N", "P", "T", "W", "G", "C"], int(g.integers(1, 3))):
        words.insert(int(g.integers(0, len(words) + 1)), "{%s}%s" % (slot, "," if g.random() < 0.15 else "'s" if g.random() < 0.05 else ""))
    return " ".join(words) + str(g.choice([".", ".", ".", "?", "!", ":", ""]))


def sentence(frame: str, g: np.random.Generator, extra: list[str] | None = None, ordinary: list[str] | None = None) -> tuple[str, list[int]]:
    """A frame filled, and the tag of each character."""
    text, tags = "", []
    for piece in re.split(r"(\{\w\})", frame):
        if not re.fullmatch(r"\{\w\}", piece):
            text += piece
            tags += [0] * len(piece)
            continue
        before, kind, value = _slot(piece[1], g, extra, ordinary)
        text += before + value
        k = 0 if kind is None else 2 + 2 * KINDS.index(kind)
        tags += [0] * len(before) + ([k - 1] + [k] * (len(value) - 1) if k else [0] * len(value))
    return text, tags


def made(count: int, seed: int = 19, extra: list[str] | None = None, ordinary: list[str] | None = None) -> list[tuple[str, np.ndarray]]:
    """Texts of a few sentences with the tags of their characters. extra are parts of names and ordinary words in small letters of a sample."""
    g, out = np.random.default_rng(seed), []
    for _ in range(count):
        text, tags = "", []
        for _ in range(int(g.integers(1, 6))):
            pool = PERSON if (roll := g.random()) < 0.5 else OTHER if roll < 0.6 else NOBODY
            frame = scattered(g, ordinary or []) if g.random() < 0.45 else loosened(str(pool[g.integers(len(pool))]), g, ordinary or [])
            s, t = sentence(frame, g, extra, ordinary)
            gap = str(g.choice([" ", " ", " ", "\n", "\n\n"]))
            text, tags = text + s + gap, tags + t + [0] * len(gap)
        roll = g.random()
        if roll < 0.04 and len(text.lower()) == len(text):
            text = text.lower()
        elif roll < 0.06 and len(text.upper()) == len(text):
            text = text.upper()
        out.append((text, np.array(tags, np.int8)))
    return out
