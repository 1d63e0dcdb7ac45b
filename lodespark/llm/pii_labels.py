"""The labelled table that the tagger of personal information is trained from.

Rows are lines with slots: ``{N}`` a person's name, ``{E}`` an e-mail address, ``{P}`` a phone number, ``{I}`` an identity number,
``{A}`` an address, each of which carries its label; all other slots are fillers without one. Values are drawn with a fixed seed from short
lists of common names, words and formats of several countries, and from syllables, so that neither a name nor a product
is known by its letters alone. No row and no entry was taken from the texts that the tagger is run on. With ``half`` only every second entry
(names, words, labels, streets, towns; not the formats of numbers) is used, which leaves the others for a test, and with ``rows_half`` every second row.
"""

from __future__ import annotations

import random
import re
import unicodedata

COPIES = 16  #: fillings of each row

KINDS = {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}

# Common given names, surnames, words, street and town names, formats.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark
Sandra Emily Oliver Charlotte George Amelia Harry Isla Hans Ursula Klaus Renate Jürgen Sabine Stefan Claudia Andreas Katrin Wolfgang Heike Günther Anke Pierre Nathalie Jacques Sylvie François Hélène Laurent
Camille Antoine Margaux Thierry Aurélie José Carmen Antonio Dolores Francisco Pilar Javier Lucía Miguel Marta Alejandro Rocío Giovanni Giulia Marco Francesca Paolo Chiara Andrzej Agnieszka Piotr Katarzyna Jan Zofia
Lars Ingrid Sven Astrid Bjørn Freja Mehmet Ayşe Mustafa Fatma Ahmed Fatima Omar Layla Hassan Amina Raj Priya Arjun Ananya Wei Mei Jun Hiroshi Yuki Kenji Sakura Minh Linh Ngozi Chidi Kwame Zanele Igor Olga Sergei Natalia""".split()
SURNAMES = """Smith Johnson Williams Brown Jones Davis Miller Wilson Moore Taylor Anderson Jackson White Harris Martin Thompson Walker Hall Allen Young King Wright Scott Green Baker Adams Nelson Carter Mitchell Turner
Phillips Campbell Parker Evans Edwards Collins Stewart Morris Rogers Reed Cook Morgan Bell Murphy Bailey Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder
Neumann Zimmermann Krüger Hartmann Dubois Durand Leroy Moreau Lefebvre Girard Bonnet Fontaine Rousseau Chevalier Gauthier Perrin García Martínez López Sánchez Pérez Gómez Fernández Moreno Álvarez Romero Navarro Torres
Domínguez Vázquez Rossi Russo Ferrari Esposito Bianchi Colombo Nowak Kowalski Wiśniewski Hansen Larsen Nilsson Johansson Virtanen Yılmaz Demir Khan Hussain Patel Sharma Nguyen Tran Chen Wang Tanaka Suzuki Kim Okafor Mensah
Ivanov Petrov Novák Horvat Nagy""".split()
SURNAME_ENDS = "son sen berg mann feld stein bauer man ton ley ford field wood worth brook well ini etti elli ez ado ero aux ard ier ski ska wicz ova ev ic u a o is er ström lund quist dal stad".split()
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sch sh sk sl sp st str t th tr v w x y z".split()
VOWELS = "a a a e e e i i o o u ai au ea ei ie oa oo ou y ä ö ü é".split()
CODAS = "n n r r l s m t d k p ck nd rt st ng rk lm ns x sh th ff".split()
NOUNS = """table window engine garden report letter budget meeting project market river paper music office water system story morning family country machine picture market school answer question battery
camera contract customer department document election factory figure forest game glass hospital idea island journal kitchen language library lesson license list magazine manager map member message method mirror model
module network number order owner package page parent partner pattern pencil permit phone plan plant player policy price printer process product profit program proposal purchase record region release report request result
road room route rule sample schedule science screen script section security sensor server service session signal site software source stage station storage store street strategy student subject supply survey switch target team
test theory ticket title tool topic town track trade traffic train transfer travel tree truck value vehicle version village visitor voice volume wall warehouse weather week wheel winter worker yard account address animal""".split()
ADJECTIVES = "new old large small late early final local public private simple common quick slow open broken empty full heavy light modern rough silent steady sudden useful weak young clear cold warm dry dark exact fresh idle narrow plain rare sharp tidy urgent vague".split()
VERBS = "check move build send open close test print write read sort copy store change update review plan start stop clean fix count draw carry collect compare deliver describe design improve measure replace report save select ship sign split test track train watch".split()
PAST = "checked moved built sent opened closed tested printed wrote sorted copied stored changed updated reviewed planned started stopped cleaned fixed counted drew carried collected compared delivered described designed improved measured replaced reported saved selected signed tracked".split()
PREPS = "before after during without near behind beside under inside against since until".split()
PEOPLE = "everybody they visitors managers students teams customers drivers teachers doctors workers neighbours members editors analysts developers nobody we".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December tomorrow today lunch noon midnight".split()
GERMAN = "Bericht Vertrag Rechnung Sitzung Plan Garten Fenster Maschine Lager Termin Angebot Werkzeug Drucker Straße Wasser Brief Ordner Schlüssel Zeitung Prüfung Lieferung Halle Karte Liste Woche Schule Antrag Aufgabe Pumpe Messung".split()
GERMAN_VERBS = "geprüft verschoben bestellt geliefert repariert gelesen sortiert gezählt gemessen gebaut verkauft geschrieben gelöscht bezahlt unterschrieben gefunden".split()
GERMAN_ADJECTIVES = "neuen alten großen kleinen letzten offenen leeren schweren leichten schnellen langsamen stillen klaren kalten warmen".split()
FRENCH = "rapport contrat facture réunion jardin fenêtre machine entrepôt rendez-vous offre outil imprimante route lettre dossier clé journal livraison salle carte liste semaine école demande tâche pompe mesure projet budget atelier".split()
FRENCH_VERBS = "vérifié déplacé commandé livré réparé lu trié compté mesuré construit vendu écrit supprimé payé signé trouvé".split()
FRENCH_ADJECTIVES = "nouveau ancien grand petit dernier ouvert vide lourd léger rapide lent calme clair froid utile".split()
SPANISH = "informe contrato factura reunión jardín ventana máquina almacén cita oferta herramienta impresora carretera carta carpeta llave periódico entrega sala mapa lista semana escuela solicitud tarea bomba medida proyecto presupuesto taller".split()
SPANISH_VERBS = "revisado movido pedido entregado reparado leído ordenado contado medido construido vendido escrito borrado pagado firmado encontrado".split()
SPANISH_ADJECTIVES = "nuevo antiguo grande pequeño último abierto vacío pesado ligero rápido lento claro frío útil raro".split()
PRODUCTS = "Server Suite Cloud Engine Platform Pipeline Cluster Dashboard Release Toolkit Framework Model Project Initiative Programme Studio Hub Gateway Edition Library Protocol System Index Router".split()
MAIL_WORDS = "mail post web home office corp team net online box data work hello info shop lab".split()
TLDS = "com org net de fr es uk io eu info co.uk edu it nl ch at test example invalid".split()
STREETS = """Main Oak Church High Mill Station Park Maple Cedar Elm Lake Hill Bridge Market Spring Washington Lincoln Victoria Queen King Castle Meadow Forest Sunset Chestnut Willow Walnut Garden Harbour Windmill Orchard
Stone Valley Manor Abbey Canal Baker Granary Ferry Cherry""".split()
STREET_KINDS = "Street Street St St. Road Rd Rd. Lane Ln Ln. Avenue Ave Ave. Court Ct Drive Dr Dr. Way Square Sq. Place Pl Close Terrace Crescent Boulevard Blvd Blvd. Row Grove Gardens Hill Mews Walk Parade".split()
UNITS = ["Flat", "Unit", "Apt", "Apt.", "Apartment", "Suite", "Room", "Floor", "#"]
GERMAN_STREETS = "Haupt Bahnhof Garten Schul Berg Linden Kirch Wald Mühlen Rosen Goethe Schiller Birken Wiesen Feld Ring Markt Brunnen Mozart Tannen Kaiser Eichen Ufer Post".split()
GERMAN_ENDS = ["straße", "straße", "str.", "strasse", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig"]
GERMAN_WAYS = ["Am", "An der", "Im", "Zum", "Auf dem", "Unter den", "In der", "Hinter der"]
FRENCH_KINDS = "rue rue rue avenue boulevard place impasse chemin quai allée cours passage route square".split()
FRENCH_STREETS = ["de la République", "Victor Hugo", "de l'Église", "du Général Leclerc", "des Lilas", "de la Gare", "du Moulin", "Pasteur", "des Écoles", "de la Paix", "du Château", "Saint-Martin", "des Vignes", "de la Fontaine"]
SPANISH_KINDS = ["Calle", "Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda", "Carrer"]
SPANISH_STREETS = ["Mayor", "de la Constitución", "del Sol", "de Alcalá", "San Juan", "de la Iglesia", "del Carmen", "de los Reyes", "Nueva", "de las Flores", "del Río", "de la Paz"]
TOWNS = """London Leeds Bristol Boston Denver Austin Portland Springfield Berlin Hamburg München Köln Leipzig Stuttgart Paris Lyon Nantes Toulouse Lille Madrid Sevilla Valencia Zaragoza Bilbao Toronto Sydney Dublin Wien Zürich Roma Milano
Oslo Utrecht Gent""".split()
PARTICLES = ["de", "de la", "del", "van", "van der", "van den", "von", "von der", "di", "da", "dos", "du", "le", "bin", "al", "ter", "zu"]

PHONE_LABELS = "Phone;phone;Tel;Tel.;tel;tel.;T;Fax;fax;phone/fax;tel/fax;Mobile;mobile;Mob.;M;cell;Cell;P;hotline;Hotline;call;Call;Dial;dial;ring;Ring;SMS;WhatsApp;Telefon;Mobil;Handy;Rückruf;Rufnummer;Fon;Tél.;Téléphone;téléphone;portable;Portable;Appel;Teléfono;teléfono;móvil;Móvil;Tfno.".split(";")
MAIL_LABELS = "Email;E-mail;e-mail;email;mail;Mail;E;from;From;To;to;Reply-To;cc;Cc;Bcc;E-Mail;Courriel;courriel;Correo;correo;contact;Contact".split(";")
ADDRESS_LABELS = "Address;address;Location;location;Office;Home;home;Ship to;Street;Venue;Billing address;Delivery address;Visit;visit;Anschrift;Adresse;adresse;Lieferadresse;Standort;Ort;Siège;Lieu;Dirección;dirección;Domicilio;Lugar".split(";")
NAME_LABELS = "Name;name;Full name;full_name;Contact;Owner;Author;Assignee;Reporter;Reviewer;Lead;Chair;Speaker;Host;Guest;Customer;Client;Signed;From;To;cc;Cc;Attendees;Participants;Present;Ansprechpartner;Zuständig;Verantwortlich;Autor;Teilnehmer;Kunde;Responsable;Auteur;Participants ;Présents;Asistentes;Contacto;Cliente;Autora".split(";")
CLOSINGS = "Best,;Best regards,;Kind regards,;Regards,;Thanks,;Thank you,;Many thanks,;Cheers,;Sincerely,;Yours,;Warm regards,;--;-- ;—;Viele Grüße;Viele Grüsse;Liebe Grüße,;Mit freundlichen Grüßen;Beste Grüße,;Danke,;Gruß;Cordialement,;Bien à vous,;Merci,;Amicalement,;À bientôt,;Saludos,;Un saludo,;Atentamente,;Gracias,;Un abrazo,".split(";")
SEPARATORS = [": ", ": ", ": ", " ", " ", " ", " : ", ":", " - ", " = ", "\t", "; ", "# "]
ID_LABELS = """SSN;SSN no.;social security number;social security no.;Social Security;NI number;NINO;national insurance number;national insurance no.;insurance number;insurance no.;passport;passport no.;passport number;Passport;travel document;travel document no.;ID number
;ID no.;ID card;identity card;identity number;national ID;personal ID;tax ID;tax number;tax no.;TIN;tax file number;SIN;taxpayer number;health insurance number;Personalausweis;Personalausweisnummer;Ausweisnummer;Identitätsnummer;Identifikationsnummer;Steuer-ID;Steuernummer
;Steueridentifikationsnummer;Sozialversicherungsnummer;Versicherungsnummer;Reisepass;Reisepassnummer;numéro de sécurité sociale;n° de sécurité sociale;sécurité sociale;NIR;numéro fiscal;passeport;passeport n°;numéro de passeport;carte d'identité;pièce d'identité;DNI;NIE;NIF;número de identificación
;número de identidad;número fiscal;pasaporte;número de pasaporte;número de la seguridad social;seguridad social;NSS;CPF;codice fiscale;Aadhaar""".replace("\n", "").split(";")
IDS = [
    "999-99-9999", "999-99-9999", "999 99 9999", "AA 99 99 99 A", "AA 99 99 99 A", "AA999999A", "AA 999999 A", "99 999 999 999", "99999999999", "99/999/99999", "99999999A", "99.999.999-A", "99999999-A", "A9999999A", "A-9999999-A", "9 99 99 99 999 999 99", "999999999999999",
    "9 99 99 99 999 999", "999-999-999", "999 999 999", "999999999", "A99999999", "AA9999999", "A9999999", "A99A999A9", "AA99A9999", "9999 9999 9999", "999.999.999-99", "99 999999 A 999", "AAAAA9999A", "99-9999999", "999999-9999", "AAAAAA99A99A999A",
]
PHONES = [
    "+1 999 999 9999", "+1-999-999-9999", "+1 (999) 999-9999", "+19999999999", "1-999-999-9999", "1999999 9999", "19999999999", "(999) 999-9999", "(999)999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "9999999999", "+44 20 9999 9999", "+44 9999 999999", "+44 9999 999 999", "+449999999999",
    "+44 (0)20 9999 9999", "020 9999 9999", "09999 999999", "09999 999 999", "099999999999", "0099 9999 999999", "00999999999999", "0099 99 9999999", "+49 99 99999999", "+49 999 9999999", "+49 (0)99 99999-999", "+49-999-9999999", "099/9999999", "099 99999 999", "099/99999-99",
    "(099) 9999999", "0999-9999999", "0999 999 99 99", "+33 9 99 99 99 99", "+33 (0)9 99 99 99 99", "09 99 99 99 99", "09.99.99.99.99", "0999999999", "09-99-99-99-99", "+34 999 99 99 99", "+34 999 999 999", "999 99 99 99", "999 999 999", "+39 999 999 9999", "+61 9 9999 9999", "09 9999 9999",
    "(09) 9999 9999", "+48 999 999 999", "+91 99999 99999", "+86 999 9999 9999", "+41 99 999 99 99", "+31 9 99999999", "09 9999-9999",
]

CONTACTS = """
{bye}/{N}
{bye}/{N}
{bye}/{N}/{E}
{bye}/{N}/{E}
{bye}/{N}/{P}
{bye}/{N}/{E}/{PL}{sep}{P}
{bye}/{N}/{PL}{sep}{P}/{A}
{bye}/{N}/{A}
{bye}/{N}/{E}/{P}/{A}
{bye}/{N}/{A}/{E}
{bye}/{N}/{w} team/{E}
{bye}/{N}/{A}/{K}{sep}{I}
{N}/{A}/{P}
{N}/{E}
{N}/{P}/{A}
{N} <{E}>/{A}
{N}/{PL}{sep}{P}/{EL}{sep}{E}
{NL}{sep}{N}/{AL}{sep}{A}
{NL}{sep}{N}/{NL}{sep}{N}
{NL}{sep}{N}
{K}{sep}{I}/{PL}{sep}{P}
{w};{w};{w}/{N};{E};{n}/{N};{E};{n}
{w},{w},{w}/{N},{P},{n}/{N},{P},{n}
{bye}/the {w} team
{bye}/{W} {Pr}
{NL}{sep}{w} team
{NL}{sep}{n}
""".strip("\n").split("\n")
CONTACTS = [row.replace("/", "\n") for row in CONTACTS]  # several lines each


NAMED = """
{N}
{N}
{N}
{N}
- {N}
* {N}
{d}. {N}
**{N}**
| {N} | {w} | {n} |
| {N} | {P} | {E} |
| {n} | {N} | {A} |
|{N}|{w}|
| {N} | {d2} |
{N}, {w} lead
{N} <{E}>
{N} <{E}>
"{N}" <{E}>
{N} ({E})
{N} ({w})
{N} - {P}
{N}, {P}
{N}: {P}
{N};{E};{P}
{N},{E},{n}
{n},{N},{P}
{N};{n};{w}
{"name": "{N}", "email": "{E}", "age": {d2}}
{"id": {n}, "customer": "{N}", "phone": "{P}"}
"name": "{N}",
"person": "{N}"
{"author": "{N}", "{w}": "{w}", "{K}": "{I}"}
{"name": "{N}", "email": "{E}", "{K}": "{I}", "{w}": {n}}
{"{K}": "{I}", "name": "{N}", "phone": "{P}"}
name: {N}
Name: {N}
Contact: {N}
Contact: {N}, {P}
Contact {N} on {P}.
Author: {N}
Written by {N}
by {N}, {date}
Assignee: {N}
Assigned to: {N}
assigned to {N}
assigned to {N}, {w} pending
Reporter: {N}
Reviewer: {N}
Owner: {N}
Lead: {N}
Attendees: {N}, {N}, {N}
Attendees: {N}, {N} and {n} others
Present: {N}, {N} and {N}
Participants: {N}; {N}
Apologies: {N}
Chair: {N}
From: {N}
To: {N}
Cc: {N}, {N}
cc: {N}
CC: {N}
Dear {N},
Hi {N},
Hello {N},
Kind regards, {N}
Thanks, {N}
Signed: {N}
Signed by {N} on {date}.
Approved by {N} {prep} {day}.
Customer: {N}
Employee: {N}, {K} {I}
Patient {N} was {past} {prep} {day}.
[{time}] {N}: {S}
[{time}] {N}: {F}
[{time}] {N}: {Z}
{time} {N}: {S}
{N}: {S}
<{N}> {S}
{N} wrote: {S}
{N} wrote that the {w} is {a}.
{N} said the {w} was {a}
as {N} put it, the {w} was {a}.
As {N} noted, {W} needs a {a} {w}.
{N} will {v} the {w} {prep} {day}.
{N} should {v} the {a} {w}.
{N} can {v} {n} {w} records.
{N} to {v} the {w}
{N} has {past} the {w}.
{N} {past} the {w} {prep} {day}.
{N} and {N} {past} the {a} {w}.
{N} ({w}) {past} the {w}
{N} from {W} {past} our {w}.
{N}, who {past} the {w}, left {prep} {day}.
ACTION: {N} to {v} the {w}.
We asked {N} to {v} the {w}.
We thank {N} for the {a} {w}.
I spoke with {N} about the {w}.
I met {N} {prep} the {w}.
Ask {N} about {W}.
ask {N} whether the {w} is {a}
Please forward the {w} to {N}.
The {w} was {past} by {N} and {past}.
The {w} of {N} was {a}.
According to {N}, the {w} is {a}.
Interview with {N} about {W}
Our {w} belongs to {N}.
Mr. {N} {past} the {w}.
Mr {N} {past} the {w}.
Mrs. {N} {past} the {w} {prep} {day}.
Ms. {N} has a {a} {w}.
Dr. {N} {past} the {w}.
Prof. {N} {past} a {w}.
The {w} was {past} by Mr. {N}.
The {w} was {past} by Dr. {N} {prep} {day}.
{N} lives at {A}.
Deliver to {N}, {A}
{S} {N} {past} the {w}. {S}
{S} {N} will {v} the {w}.
{S} We asked {N} about it. {S}
{S} The {w} was {past} by {N}.
Herr {N} hat den {gn} {gv}.
Frau {N} hat die {gn} {gv}.
Frau {N} braucht den {ga} {gn}.
Herrn {N} fehlt der {gn}.
Sehr geehrte Frau {N},
Mit freundlichen Grüßen {N}
Ansprechpartner: {N}
Teilnehmer: {N}, {N}
Verantwortlich: {N}
Verfasser: {N}
{N} hat den {gn} {gv}.
{N} hat die {ga} {gn} {gv}.
{N} übernimmt den {gn}.
Gespräch mit {N} über den {gn}.
Bitte bei {N} nach dem {gn} fragen.
Fragen an {N} wegen der {gn}.
Laut {N} ist der {gn} fertig. {F}
Monsieur {N} a {fv} le {fn}.
M. {N} a {fv} la {fn}.
Mme {N} a {fv} le {fn}.
Mme {N} demande un {fn} {fa}.
Bonjour {N},
Cordialement, {N}
Responsable : {N}
Participants : {N}, {N}
Auteur : {N}
{N} a {fv} le {fn}.
{N} demande un {fn} {fa}. {F}
Voir {N} pour le {fn}.
Selon {N}, le {fn} est {fa}.
Parler avec {N} de la {fn}.
Sr. {N} ha {sv} el {sn}.
Sra. {N} ha {sv} la {sn}.
La Sra. {N} pide un {sn} {sa}.
El Sr. {N} pide la {sn}.
Estimada {N}:
Atentamente, {N}
Responsable: {N}
Asistentes: {N}, {N}
Autor: {N}
{N} ha {sv} el {sn}.
{N} pide un {sn} {sa}. {F}
Hablar con {N} sobre la {sn}.
Preguntar a {N} por el {sn}.
Según {N}, el {sn} es {sa}.
联系人：{N}
参加者：{N}，{N}
""".strip("\n").split("\n")

OTHERS = """
{E}
{E}
{E}
{EL}{sep}{E}
{EL}{sep}{E}
{EL}{sep}{E}
{EL}{sep}{E}
{EL}{sep}{E}
{EL}{sep}{E}
{EL}{sep}{E}
{EL}{sep}{E}
- {E}
<{E}>
From: {E}
To: {E}
Reply to {E}.
Contact {E} for the {w}.
Contact: {E}
Send the {w} to {E}.
Send the {a} {w} to {E} {prep} {day}.
Write to {E} or {E}.
Questions? Ask {E} {prep} {day}.
{E} {past} the {w}.
{E} is {a}.
[mail us](mailto:{E})
[{w}](mailto:{E}) for the {w}
"email": "{E}",
{"email": "{E}", "{w}": {n}}
| {w} | {E} |
my address is {E}, please {v} the {w}
{S} Mail {E} about the {w}.
Schreiben Sie an {E}.
Der {gn} geht an {E}.
Écrire à {E}.
envoyer le {fn} à {E}
Escribir a {E} por el {sn}.
enviar la {sn} a {E}
{P}
{P}
{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL}{sep}{P}
{PL} {P}, {w} desk
{PL} {P}, {w} desk
{PL} {P}, {w} desk
{PL} {P}, {v} for the {w}
{PL}{sep}{P}. {S}
{S} {PL}{sep}{P}
{PL}{sep}{P} ext. {d2}
{PL}{sep}{P}, {PL}{sep}{P}
- {P}
Call {P} {prep} {day}.
Call us at {P}.
call {P} about the {w}
{P} ext. {d3}
Phone {P} ext. {d2}
dial {P} x{d3} for the {w}
{P} extension {d2} {prep} {day}
{P} is my number.
{P} is the {w} number.
{P} reaches the {w} desk
My number is {P}.
reachable at {P} {prep} {day}
They left {P} with the {w}.
Text {P} if the {w} is {a}.
"phone": "{P}",
"tel": "{P}"
| {w} | {P} |
| {P} | {w} |
{w};{P};{n}
{S} Call {P} for the {w}.
{S} Our number is {P}. {S}
Rufen Sie {P} an.
unter {P} erreichbar
Appeler le {P} pour le {fn}.
joindre au {P}
Llamar al {P} por la {sn}.
电话：{P}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
{K}{sep}{I}
- {K}: {I}
| {K} | {I} |
"{K}": "{I}"
"{K}": "{I}",
{"{w}": "{w}", "{K}": "{I}"}
{"{w}": {n}, "{K}": "{I}", "{w}": {d2}}
My {K} is {I}.
my {K} is {I}, please {v} it
The {K} on the {w} is {I}.
{K} {I} was {past} {prep} {day}.
{K}: {I} ({w} {past})
Please {v} {K} {I}.
The {w} has {K} {I} on it.
{v} {K} {I} {prep} the {w}
{w} {past} {K} {I} {prep} the {w}.
{People} {v} {K} {I} {prep} {day}.
{Aw} {w} with {K} {I} for the {w}
{K} {I} {past} the {w}
The {w} shows {K} {I}.
his {K} {I} is on the {w}
{S} {K}: {I}. {S}
{S} My {K} is {I}.
Meine {K} ist {I}.
Der {gn} nennt {K} {I}.
im {gn} steht {K} {I}.
Mon {K} est {I}.
le {fn} porte {K} {I}.
Mi {K} es {I}.
en el {sn} figura {K} {I}.
{A}
{A}
{A}
{A}
{A}
{A}
{A}
{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}
{AL}{sep}{A}. {S}
{AL}{sep}{A}. {F}
{S} {AL}{sep}{A}.
{AL}{sep}{A}, {w}
- {A}
Visit us at {A}.
Visit: {A}
We moved to {A}.
We moved to {A} {prep} {day}.
They live at {A}, near the {w}.
Send the {w} to {A}.
Deliver the {a} {w} to {A} {prep} {day}.
The {w} is at {A}.
The {w} is at {A}; please {v} it.
Our {w} stands at {A} and is {a}.
{A} is our {w}.
"address": "{A}",
"address": "{A}"
| {w} | {A} |
| {A} | {w} |
{S} Send it to {A}.
{S} We are at {A}. {S}
{w}: {A}. {S}
Wir sind in {A}.
Der {gn} steht in {A}.
Der {gn} liegt in {A}. {F}
Lieferung an {A}
Nous sommes au {A}.
Livrer le {fn} au {A}.
Estamos en {A}.
Enviar la {sn} a {A}.
地址：{A}
""".strip("\n").split("\n")

PLAIN = """
{S}
{S}
{S}
{S} {S}
{S} {S}
{S} {S} {S}
- {S}
* {S}
{d}. {S}
> {S}
- [ ] {S}
- [x] {S}
[{time}] {h}: {S}
[{time}] {h}: {F}
[{time}] {h}: {Z}
{h}: {S}
@{h} {S}
@{h} please {v} the {w}
thanks @{h}, the {w} is {a}
ping @{h} and @{h}
{F}
{F}
{F} {F}
- {F}
> {F}
{Z}
{Z}{Z}
{T}
{T}
{T}
{T}
{T}
{T}
{T}
{T}
{T}
{T}
{T}.
{T}. {T}
{T}, {T}
{U}
{U}
{U}
{U}
{U}.
{L}
{L}
# {W}
# {Aw} {Nw}
# {Aw} {Nw} {W}
## {Nw} {n}
## {W}: {w}, {w}
### {Nw} / {Nw}
# {W}: {gn}, {gn}
# {fn} {fa}
## {W} {Nw}
{Nw}: {w}
{Nw}: {w} {w}
{Nw}: {W}
Status: {a}
Priority: {d}
Owner: {w} team
Assignee: nobody
Attendees: {n}
From: {w} desk
Room: {w} {d2}
Date: {date}
Time: {time}
Ticket: {tk}
Ticket {tk}
{tk}: {a} {w}
# {tk}
{tk}
Subject: {T}
Subject: {Aw} {w}
Re: {Aw} {w} {W}
Hi all,
Hello team,
Dear {w} team,
Best regards,
Kind regards,
Thanks,
Cheers,
Bonjour à tous,
Hallo zusammen,
Viele Grüße
Liebe Grüße,
Cordialement,
Hola a todos,
Saludos,
| {w} | {w} | {n} |
| {Nw} | {Nw} |
| {Nw} | {W} | {a} |
| --- | --- | --- |
{w},{w},{n}
{w};{a};{n};{n}
{"{w}": "{w}", "{w}": {n}}
{"{w}": "{S}", "{w}": "{L}"}
  "{w}": "{a}",
  "{w}.{w}": {n}
  "{w}": "{w}-{n}",
  "{w}.{w}": "{w}_{n}"
{"{w}": "{w}-{d3}", "{w}": "{w}"}
{w}-{n}
{w}-{d3}: {a}
- {w}-{n} {past} the {w}
The {w} {w}-{d2} is {a}.
{w}: {n}
{w} = {n}
const {w} = {w}.{v}({n});
{w}_{w} = {v}({w}, {n})
def {v}_{w}({w}): return {w}
if {w} > {n}: {v}({w})
return {w}[{n}]
SELECT {w} FROM {w} WHERE {w} = {n};
import {w}
$ {v} --{w}={n} ./{w}/{w}.txt
/{w}/{w}/{w}.md
/home/{w}/{w}@2x.png
https://{w}.example.org/{w}/{n}
git@{w}.example.org:{w}/{w}.git
see https://{w}.example.com/{w}?{w}={n}
npm install {w}@{d}.{d2}.{d}
{v} {w}@{d}.{d}.{d2} {prep} {day}
root@{w} {past} the {w}
{h}@{w} {past} the {w}
version {d}.{d2}.{d3}
Release {d}.{d2} of {W} is {a}.
build {n}.{d2} {past}
The server {d2}.{d3}.{d2}.{d} is {a}.
10.0.{d}.{d2}:{n} is {a}
Order {n}{d3}-{d3} was {past}.
Order no. {n}{n} {past} {prep} {day}.
Invoice {d3}-{n} is {a}.
Invoice {n}{d2} from {date}
Ticket {n}{d3} was {past}.
Part number {d3}-{d3}-{n}
Item {d2}-{d2}-{n}: {a} {w}
Serial {d3} {d3} {d3} {d3}
ISBN 978-{d}-{d3}-{n}-{d}
ISBN 978-{d}-{d2}-{n}{d2}-{d}
ID {tk}, issue #{n}
See section {d}.{d2} and table {n}.
RFC {n} and ISO {n}-{d}
{d2} {d3} {d3} rows of {w}
{n} {n} {n}
{d}.{d3}.{d3} {w} units
{d2}.{d2} % of the {w}
{d2},{d3}.{d2} {w}
{n} ms, {d3} MB, {d2} threads
It took {n}.{d2} seconds.
between {n} and {n} {w} entries
from {date} to {date}
{date} {time}
{date}T{time}:00Z {a} {w}
20{d2}-0{d}-{d2} {w} {past}
in 20{d2} the {w} was {a}
hash {hex}
{hex} {w}
commit {hex} {past} the {w}
The {n} {a} {w} rows are {a}.
{n} street signs were {past}.
{n} {w} street lamps near the road
The road plan has {n} pages.
Lane {d} is {a}, court {d2} is not.
The {w} at gate {d2} is {a}.
the {G} {Pr} runs {n} jobs
The {G} {Pr} is {a}.
The {G} {Pr} {past} {n} {w} records.
Install {G} {Pr} {d}.{d}.
Upgrade to {G} {Pr} {n}.{d2}.
Project {G} starts {prep} {day}.
Project {G} {w} is {a}.
Operation {G} was {a}.
{G} {Pr} release notes
{G} is {a}.
{G} said hello.
{G} will {v} the {w}.
{W} {Pr} is {a}.
The {W} {Pr} has a {a} {w}.
{W} Ltd and {W} GmbH {past} the {w}.
The University of {W} {past} a {w}.
We met in {town}.
The {town} office is {a}.
{town} and {town} share a {w}.
{W} and {W} share a {a} {w}.
{W}, {W} and {W} are {a}.
{W} keeps its {w} {prep} the {w}.
without {W} the {w} is {a}
**{Nw}** and _{w}_
every {w} is _{a}_ or **{a}**
`{w}` {past} `{w}`
```{w}
    {w} {w} {n}
[{w}]({w}.md)
![{w} {w}]({w}.png)
""".strip("\n").split("\n")

SENTENCES = """
The {a} {w} is {a}.
The {w} was {past} {prep} {day}.
{People} {past} the {w} {prep} the {w}.
{People} {past} {n} {w} records {prep} {day}.
We should {v} the {w} and {v} every {w}.
Please {v} the {a} {w} {prep} {day}.
A {a} {w} and a {a} {w} rarely match.
Does the {w} still {v} the {w}?
Why did {people} {v} the {a} {w}?
{W} has a {a} {w}.
{W} {past} its {w}, and {people} {past} the {w}.
If the {w} is {a}, {v} it.
In {day}, {people} {past} {n} {a} {w} parts.
There are {n} {w} rules in {W}.
My {w} was {a}, but the {w} of {W} was {a}.
No {w} is {a} because {people} {past} it.
To {v} a {w}, {v} the {w} first.
Only {a} {w} parts reach {W}.
It is {a} that {W} and the {w} share {n} parts.
Nothing in the {w} explains why {W} {past} the {w}.
Most {w} plans ({n} of them) were {a}.
Our {w} grew {a}; the {w} stayed {a}.
"{Aw} {w} first" is what {people} wrote.
This {w} shows how {W} can {v} a {w}, an {w} or the {w}.
Once {people} {past} {W}, every {w} seemed {a}.
Two {people} {past} it twice.
That is {a}, not {a}.
Yesterday {people} {past} all of it.
Which {w} did {W} {v}, and when?
We {v} {W} and {W} {prep} {day}.
We should {v} {W} {prep} the {w}.
The {w} to {v} is {W}, not {W}.
{People} {v} {W}, then the {a} {w} {W}.
Use {W} or a {a} {w}.
A {a} {w}, {W}, was {past} {prep} {day}.
When {people} leave, {v} the {w}.
""".strip("\n").split("\n")

FOREIGN = """
Der {gn} wurde {gv}.
Die {gn} ist nicht {gv}.
Wir haben den {ga} {gn} {gv}.
Die {ga} {gn} von {W} bleiben offen.
Warum ist die {gn} noch nicht {gv}?
Bitte den {gn} und die {gn} prüfen.
Im {gn} stehen {n} Zeilen über {W}.
Das Team hat {n} {gn} {gv}, obwohl {W} fehlt.
Seit {n} Tagen ist der {gn} weg.
Ohne {gn} kann {W} nichts tun.
Kein {gn} und keine {gn} wurden {gv}.
Alle {ga} {gn} sind da.
Die {gn} von {gn} wurde {gv}.
{gn} von {W} und {gn} von {ga} {gn} sind {gv}.
{gn} und {gn} fehlen, {gn} nicht.
Es gibt {ga} {gn}, {gn} und {n} {gn}.
Die {gn} hat {W} {gv} und {W} bleibt da.
Wenn {W} nicht {gv} ist, hilft die {gn}.
Wir wollen {W} mit {W} vergleichen.
Nach {W} kommt die {gn}, dann der {gn}.
Le {fn} a été {fv}.
La {fn} n'est pas {fa}.
Nous avons {fv} le {fn} de {W}.
Il faut {n} pages pour le {fn} {fa}.
Pourquoi le {fn} est-il {fa} ?
L'équipe a {fv} les {fn}s et {n} {fn}s.
Sans {fn}, {W} reste {fa}.
On a {fv} la {fn} avant midi.
Aucun {fn} de {W} n'est {fa}.
Les {fn}s de {W} sont arrivés.
Si {W} est {fv}, la {fn} reste {fa}.
Nous allons vers {W} avec {W} et la {fn}.
El {sn} ha sido {sv}.
La {sn} no es {sa}.
Hemos {sv} el {sn} de {W}.
Hay {n} páginas en el {sn} {sa}.
¿Por qué el {sn} es tan {sa}?
El equipo ha {sv} la {sn} y {n} cosas.
Sin {sn}, {W} no funciona.
Antes de comer se ha {sv} la {sn}.
Ningún {sn} de {W} es {sa}.
Las cosas de {W} han llegado.
Si {W} está {sv}, la {sn} queda {sa}.
Vamos a {W} con {W} y la {sn}.
""".strip("\n").split("\n")

CHINESE = ["我们检查了{n}个项目。", "{W}的报告很重要。", "请在会议之前更新文件。", "昨天大家讨论了{W}的计划，没有结果。", "为什么系统还没有准备好？", "他们把{n}张表放在桌子上。"]


def plain_letters(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in shape)


def known_names(given: list[str]) -> list[str]:
    """The given names that are looked up: those of the reference list and of this table."""
    return sorted({*given, *GIVEN})


class Lines:
    """Fills the rows of the table. ``half`` 0 or 1 uses every second entry of the lists; None all."""

    def __init__(self, given: list[str], seed: int, half: int | None = None):
        self.r = random.Random(seed)
        self.part = (lambda xs: list(xs)) if half is None else (lambda xs: list(xs)[half::2])
        self.listed = self.part(known_names(given))
        for name in ("SURNAMES", "SURNAME_ENDS", "NOUNS", "ADJECTIVES", "STREETS", "GERMAN_STREETS", "FRENCH_STREETS", "SPANISH_STREETS", "TOWNS", "SENTENCES", "FOREIGN", "PRODUCTS", "MAIL_WORDS", "VERBS", "PAST", "PHONE_LABELS", "MAIL_LABELS", "ADDRESS_LABELS", "NAME_LABELS", "CLOSINGS", "ID_LABELS"):
            setattr(self, name.lower(), self.part(globals()[name]))
        pick = lambda xs: lambda: self.r.choice(xs)
        r = self.r
        self.fill = {
            "N": self.name, "E": self.email, "P": lambda: _digits(r, r.choice(PHONES)), "I": lambda: _digits(r, r.choice(IDS)), "A": self.address, "K": pick(self.id_labels),
            "w": self.noun, "a": self.adjective, "v": lambda: r.choice(self.verbs) if r.random() < 0.7 else self.invented(r.choice([1, 2])).lower(), "past": lambda: r.choice(self.past) if r.random() < 0.7 else self.invented(r.choice([1, 2])).lower() + "ed", "prep": pick(PREPS), "day": pick(DAYS), "W": self.place, "G": lambda: r.choice([*self.listed, self.given_name()]),
            "Nw": lambda: self.noun().capitalize(), "Aw": lambda: r.choice(self.adjectives).capitalize(), "Pr": pick(self.products), "People": lambda: r.choice(PEOPLE).capitalize(), "people": pick(PEOPLE),
            "gn": lambda: r.choice(GERMAN) if r.random() < 0.6 else self.invented(r.choice([1, 2])) + r.choice(["ung", "heit", "er", "schaft", "tion", "e", "en", "ungen", "tel", "rat"]), "gv": pick(GERMAN_VERBS), "ga": pick(GERMAN_ADJECTIVES), "fn": lambda: r.choice(FRENCH) if r.random() < 0.6 else self.invented(r.choice([1, 2])).lower() + r.choice(["age", "tion", "eur", "ée", "ment", "ie", "ette", "ure"]), "fv": pick(FRENCH_VERBS), "fa": pick(FRENCH_ADJECTIVES), "sn": lambda: r.choice(SPANISH) if r.random() < 0.6 else self.invented(r.choice([1, 2])).lower() + r.choice(["ción", "dad", "era", "ado", "ista", "aje", "os", "as"]), "sv": pick(SPANISH_VERBS), "sa": pick(SPANISH_ADJECTIVES),
            "S": lambda: self.text(r.choice(self.sentences)), "F": lambda: self.text(r.choice(self.foreign)), "Z": lambda: self.text(r.choice(CHINESE)),
            "T": lambda: self.text(r.choice([*self.sentences, *self.sentences, *self.foreign])).rstrip(".?").title(), "U": lambda: self.text(r.choice([*self.sentences, *self.foreign])).rstrip(".?").upper(), "L": lambda: self.text(r.choice([*self.sentences, *self.foreign])).rstrip(".?").lower(),
            "town": pick(self.towns), "PL": pick(self.phone_labels), "EL": pick(self.mail_labels), "AL": pick(self.address_labels), "NL": pick(self.name_labels), "bye": pick(self.closings), "sep": pick(SEPARATORS), "h": lambda: r.choice([self.noun(), self.invented(1).lower(), r.choice(self.listed).lower()]) + r.choice(["", str(r.randint(0, 99)), "_" + self.noun()]),
            "d": lambda: str(r.randint(0, 9)), "d2": lambda: f"{r.randint(0, 99):02d}", "d3": lambda: f"{r.randint(0, 999):03d}", "n": lambda: str(r.choice([r.randint(2, 99), r.randint(100, 9999)])),
            "tk": lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(2, 5))) + r.choice(["-", "-", "_", ""]) + str(r.randint(1, 99999)), "hex": lambda: f"{r.getrandbits(48):012x}", "time": lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}",
            "date": lambda: r.choice(["20{a:02d}-{b:02d}-{c:02d}", "{c:02d}.{b:02d}.20{a:02d}", "{b}/{c}/20{a:02d}", "{c} May 20{a:02d}"]).format(a=r.randint(0, 29), b=r.randint(1, 12), c=r.randint(1, 28)),
        }

    def invented(self, syllables: int) -> str:
        r = self.r
        return "".join(r.choice(ONSETS) + r.choice(VOWELS) + (r.choice(CODAS) if r.random() < 0.5 else "") for _ in range(syllables)).capitalize()

    def noun(self) -> str:
        """A common noun; some are made up, as no list of words is complete."""
        x = self.r.random()
        return self.r.choice(self.nouns) if x < 0.7 else self.invented(self.r.choice([1, 2])).lower() + self.r.choice(["er", "ing", "tion", "ment", "ness", "", "age", "ette", "s"])

    def adjective(self) -> str:
        return self.r.choice(self.adjectives) if self.r.random() < 0.7 else self.invented(self.r.choice([1, 2])).lower() + self.r.choice(["y", "al", "ive", "ous", "able", "ed", "ic", "less"])

    def place(self) -> str:
        return self.invented(self.r.choice([2, 2, 3])) if self.r.random() < 0.8 else self.r.choice(self.towns)

    def given_name(self) -> str:
        x = self.r.random()
        return self.r.choice(self.listed) if x < 0.65 else self.invented(self.r.choice([1, 2, 2]))

    def surname(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.3:
            return r.choice(self.surnames)
        if x < 0.65:
            return self.invented(1) + r.choice(self.surname_ends)
        if x < 0.8:
            return r.choice(self.nouns).capitalize() + r.choice(self.surname_ends)
        return self.invented(2) if x < 0.96 else r.choice(["O'", "Mc", "D'", "Mac"]) + self.invented(1)

    def name(self) -> str:
        r = self.r
        low = r.random() < 0.12  # in small letters only a listed given name tells a name from other words
        g, s = r.choice(self.listed) if low and r.random() < 0.85 else self.given_name(), self.surname()
        x = r.random()
        if x < 0.12:
            s = f"{s}-{self.surname()}"
        elif x < 0.27:
            s = f"{r.choice(PARTICLES)} {s}"
        elif x < 0.31:
            s = f"{s} {self.surname()}"
        x = r.random()
        middle = f" {r.choice('ABCDEFGHJKLMNPRSTW')}." if x < 0.13 else f" {self.given_name()}" if x < 0.17 else f"-{self.given_name()}" if x < 0.2 else "".join(f" {self.given_name()}" for _ in range(r.randint(2, 3))) if x < 0.22 else ""
        x = r.random()
        if x < 0.16:
            full = f"{s}, {g}{middle}"
        elif x < 0.2:
            full = f"{s.upper()}, {g}" if r.random() < 0.5 else f"{s.upper()} {g}"
        elif x < 0.24:
            full = f"{g} {s.upper()}"
        elif x < 0.28:
            full = f"{s} {g}"
        else:
            full = f"{g}{middle} {s}"
        x = r.random()
        return full.lower() if low else full.upper() if x < 0.09 else plain_letters(full) if x < 0.2 else full

    def host(self) -> str:
        r = self.r
        own = self.invented(r.choice([1, 2, 2])).lower() if r.random() < 0.6 else r.choice(self.nouns)
        own = plain_letters(own)
        x = r.random()
        own = f"{r.choice(self.mail_words)}.{own}" if x < 0.2 else f"{own}-{r.choice(self.mail_words)}" if x < 0.3 else own + r.choice(self.mail_words) if x < 0.4 else own
        return f"{own}.{r.choice(TLDS)}"

    def email(self) -> str:
        r = self.r
        g, s = (re.sub(r"[^a-z]", "", plain_letters(x).lower()) or "x" for x in (self.given_name(), self.surname()))
        local = r.choice([f"{g}.{s}", f"{g}.{s}", f"{g[0]}{s}", f"{g}{s}", f"{g}_{s}", f"{g}-{s}", f"{s}.{g}", f"{g}{r.randint(1, 99)}", f"{s}_{g}{r.randint(0, 99)}", f"{g}+{r.choice(self.nouns)}", s, f"{g[0]}.{s}", r.choice(self.mail_words)])
        host, x = self.host(), r.random()
        if x < 0.24:
            at, dot = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" AT ", " DOT "), (" at ", " dot "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", "."), (" AT ", "."), (" at ", "."), (" <at> ", " <dot> ")])
            return local + at + host.replace(".", dot)
        whole = f"{local}@{host}"
        return whole.upper() if x < 0.3 else ".".join(p.capitalize() for p in local.split(".")) + "@" + host if x < 0.38 else whole

    def address(self) -> str:
        r = self.r
        town = r.choice(self.towns) if r.random() < 0.5 else self.invented(2) + r.choice(["", "", "ton", "ville", "dorf", "burg"])
        x = r.random()
        town = f"{r.choice(['Saint', 'Sainte', 'San', 'Bad', 'St', 'Port', 'New', 'Santa'])}{r.choice(['-', ' '])}{town}" if x < 0.12 else f"{town}-{self.invented(1)}" if x < 0.2 else f"{town}-sur-{self.invented(1)}" if x < 0.24 else town
        odd = lambda xs: r.choice(xs) if r.random() < 0.55 else self.invented(r.choice([1, 2, 2]))
        number, five, x = str(r.randint(1, r.choice([30, 300, 3000]))), f"{r.randint(0, 99999):05d}", r.random()
        if x < 0.46:
            street = odd(self.streets) + (r.choice(["", "", "wood", "field", "gate", " " + r.choice(self.streets)]) if r.random() < 0.3 else "")
            out = f"{number}{r.choice('ABC') if r.random() < 0.12 else ''} {street} {r.choice(STREET_KINDS)}"
            unit = f"{r.choice(UNITS)} {r.randint(1, 60)}".replace("# ", "#") + (r.choice("AB") if r.random() < 0.1 else "")
            y = r.random()
            out = f"{out}, {unit}" if y < 0.25 else f"{unit}, {out}" if y < 0.3 else out
            y = r.random()
            uk = f"{_digits(r, r.choice(['A9', 'AA9', 'AA99', 'A99', 'AA9A']))} {_digits(r, '9AA')}"
            return out + (f", {town}" if y < 0.28 else f", {town} {five}" if y < 0.42 else f", {town}, {r.choice(['CA', 'NY', 'TX', 'OH', 'WA'])} {five}" if y < 0.46 else f", {town}, {uk}" if y < 0.54 else f", {town} {uk}" if y < 0.6 else "")
        tail = f", {five} {town}" if r.random() < 0.62 else f", {town}" if r.random() < 0.15 else ""
        if x < 0.66:
            letter = r.choice(["", "", "", "", "a", " b", "-" + str(r.randint(5, 99))])
            if r.random() < 0.12:
                return f"{r.choice(GERMAN_WAYS)} {odd(self.german_streets)} {number}{letter}{tail}"
            way = odd(self.german_streets) + (r.choice(GERMAN_ENDS) if r.random() < 0.75 else r.choice(["er Straße", "er Weg", "-Straße", "-Allee", "-Platz", " Straße", " Str.", "er Platz", "-Weg"]))
            return f"{way} {number}{letter}{tail}"
        if x < 0.84:
            named = r.choice(self.french_streets) if r.random() < 0.5 else r.choice(["de la ", "du ", "des ", "de ", "de l'", ""]) + self.invented(2) + r.choice(["", "", "s", "-" + self.invented(1)])
            kind = r.choice(FRENCH_KINDS)
            return f"{number}{r.choice(['', '', '', ' bis', ' ter', 'B'])}{r.choice(['', '', ','])} {kind if r.random() < 0.8 else kind.capitalize()} {named}{tail}"
        named = r.choice(self.spanish_streets) if r.random() < 0.5 else r.choice(["de la ", "del ", "de los ", "de ", ""]) + self.invented(2)
        floor = r.choice([f", {r.randint(1, 9)}º {r.choice('ABCD')}", f", {r.randint(1, 9)}º{r.choice('ABCD')}", f", piso {r.randint(1, 9)}", f", {r.randint(1, 9)}.º dcha."]) if r.random() < 0.3 else ""
        return f"{r.choice(SPANISH_KINDS)} {named}{r.choice(['', '', ','])} {number}{floor}{tail}"

    def text(self, row: str) -> str:
        return re.sub(r"\{([A-Za-z]\w*)\}", lambda m: self.fill[m.group(1)](), row)

    def line(self, row: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{([A-Za-z]\w*)\}", row):
            text += row[at : m.start()]
            value = self.fill[m.group(1)]()
            if m.group(1) in KINDS:
                spans.append((len(text), len(text) + len(value), m.group(1)))
            text += value
            at = m.end()
        return text + row[at:], spans


def labelled_lines(given: list[str], copies: int = COPIES, seed: int = 11, half: int | None = None, rows_half: int | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``(text, [(start, end, kind)])`` of every row of the table, each filled ``copies`` times (twice as often with an address), in texts of one to four rows.

    ``half`` 0 or 1 takes every second entry of the lists, ``rows_half`` every second row.
    """
    lines = Lines(given, seed, half)
    part = lambda xs: xs if rows_half is None else xs[rows_half::2]
    rows = [row for some in (NAMED, OTHERS, PLAIN, CONTACTS * 6) for row in part(some)]
    filled = [lines.line(row) for row in rows for _ in range(3 if "{" not in row else copies * (2 if "{A}" in row else 1))]
    lines.r.shuffle(filled)
    out, at = [], 0
    while at < len(filled):
        text, spans = "", []
        for line, own in filled[at : at + (n := lines.r.choice([1, 2, 3, 4]))]:
            text += lines.r.choice(["\n", "\n\n"]) if text else ""
            spans += [(a + len(text), b + len(text), kind) for a, b, kind in own]
            text += line
        out.append((text, spans))
        at += n
    return out
