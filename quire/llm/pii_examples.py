"""The labelled table that the tagger of personal information is trained on: invented sentences with slots, and what fills them."""

from __future__ import annotations

import random
from collections.abc import Iterator

FIRST = (
    "Marie Jean Paul Sophie Pierre Claire Julien Amélie Thomas Camille Nicolas Élodie Antoine Chloé Étienne Inès Karim Fatima Olivier Hélène Jeanne Luc Zoé Anaïs Mathieu John Mary James Emily Robert "
    "Alice William Grace Henry Laura Oliver Emma Daniel Megan Peter Susan Yuki Ahmed Lucia Marco Ingrid Pavel Rosalind Edgar Ophélie Solène Gauvain Thibault Aurèle Cédric Ludivine"
).split()
LAST = (
    "Martin Bernard Dubois Lefèvre Moreau Girard Fournier Lambert Rousseau Faure Mercier Blanc Guérin Boyer Garnier Chevalier Perrin Marchand Dufour Smith Jones Taylor Brown Wilson Evans Walker Wright "
    "Hughes Green Hall Wood Clarke Harris Turner Morgan Cooper Bailey Bennett Foster Okafor Nguyen Rossi Schmidt Novak Haddad Keller Vasseur Quentin Tesson Barrière Prévost Montagne Lanoix Kervella"
).split()
TITLE_FR, TITLE_EN = ["M.", "Mme", "Mlle", "Dr", "Me", "Pr"], ["Mr", "Mrs", "Ms", "Dr", "Mr.", "Prof."]
STREET_FR = "rue|avenue|boulevard|impasse|chemin|allée|place|quai|cours|route|square|passage|faubourg|sentier|ruelle|av.|av.|av.|ave|bd|bd.|bd.|blvd|lotissement|résidence|hameau|cité|esplanade|promenade|montée|traverse|villa|ch.|pl.|lieu-dit|voie|Rue|Avenue|Boulevard".split("|")
OF_FR = ["des Lilas", "du Moulin", "de la Gare", "de l'Église", "des Acacias", "Victor Hugo", "du Vieux Port", "de la Petite Fontaine", "des Deux Ponts", "du Puits à Roue", "Jean Jaurès", "Saint-Michel", "de l'Hôtel de Ville", "des Quatre Vents", "du Pré Vert", "du Bac", "de la Grande Rue", "du Four à Pain", "de la Belle Étoile", "de la Vieille Tour", "des Trois Sources", "de l'Abreuvoir", "de la Grande Ourse", "du Champ à Bœufs"]
NAME_EN = ["Baker", "High", "Mill", "Church", "Oak Hill", "Silver Birch", "Long Meadow", "New Forge", "Station", "Queen Anne", "Elmwood", "Rosemoor", "Foxglove", "Low Barn", "Greenfield", "Cherry Orchard"]
STREET_EN = "Street Road Lane Avenue Drive Close Terrace Court Way Place Crescent Gardens Square St. Rd. Row".split()
TOWN = ["Lyon", "Nantes", "Villefranche", "Montreuil", "Saint-Denis", "Aix-les-Bains", "Châlons-en-Champagne", "Bourg-la-Reine", "Springfield", "Oakham", "Kingsbury", "Newport", "Ashford", "Marbourg-le-Vieux", "Riverton", "Beaumont"]
DOMAIN = ["exemple", "courriel", "mail", "bureau", "societe-test", "poste", "firm", "office", "contoso", "reseau"]
COMPANY = ["Durandal", "Nordex", "Altaris", "Clairval", "Novatek", "Belmonte", "Acrys", "Orvane", "Lumeris", "Trigane", "Maxiline", "Verdane", "Solenys", "Cortexia", "Pranelia"]
PUBLIC = "Levées Locales Affaires Générales Travaux Urbains Archives Centrales Ressources Humaines Marchés Publics Recettes Comptes Foncières Régionales Taxes Communales Registres Ruraux Services Fiscaux Baux Domaines Eastern Planning Records Public Works Rural Archives".split()
SYLLABLES = "ba bel bri ca cor da del du fa fer gar gri hel jo jor ka lan le lor ma mar mer na nor o per pra quin ra rem ro sa sor ta tel ti tor va ver vi wes za".split()
ENDS = "dane mond vier lène thée rin win nor gard mire zeau vaz lard moux ton sac quel chon peyre feld".split()

POSITIVE = [
    "Contact : {name}, tél. {phone}.", "Contact: {name}, phone {phone}.", "Contact : {titled}, tél. {phone}", "Personne à joindre : {name} ({email}), tél. {phone}", "Signé : {name}", "Signed: {name}",
    "Signed by {name} on behalf of the board.", "Auteur : {name}", "Author: {name}", "# Author: {name}", "Rédigé par {name} le {date}.", "Written by {name} <{email}>", "Rapporté par {name} <{email}>.", "Reported by {name} <{email}>.",
    "Dossier suivi par {titled} ({email}).", "Affaire confiée à {titled}, joignable au {phone}.", "Case handled by {titled} ({email}).", "Présents : {name}, {name}, {name}.", "Présents : {name}, {name} et {name}.",
    "Étaient présents {name} et {titled}.", "Attendees: {name}, {name} and {name}.", "Absent: {name}.", "Rappeler {name} au {phone} avant la clôture.", "Merci de rappeler {titled} au {phone}.", "Please call {name} on {phone} before Friday.",
    "Call {titled} at {phone}.", "Joindre le {phone}.", "Joindre {name} au {phone}.", "Téléphone : {phone}", "Tél. : {phone}", "Phone: {phone}", "Mobile {phone}, fax {phone}.", "ou appeler le {phone}.", "or call {phone}.",
    "Pour toute question, écrire à {email} ou appeler le {phone}.", "For questions write to {email} or call {phone}.", "Écrire à {email}.", "Send it to {email} today.", "Courriel : {email}", "Email: {email}", "E-mail : {email}.",
    "Cc: {email}; {email}", "To: {email}, {email}", "répondre à {email} avant vendredi", "{name};{phone};{email}", "{name},{email},{phone}", "{name} | {phone} | {email}",
    "Numéro de sécurité sociale : {id}.", "Social security number: {id}.", "N° SS {id}", "Le numéro fiscal {id} est rattaché au compte de {name}.", "Tax id {id} belongs to {name}.", "Numéro fiscal : {id}",
    "Passport {id} was issued to {titled}.", "Passeport {id} délivré à {titled}.", "Pièce d'identité n° {id} délivrée à {titled}.", "Carte d'identité {id} au nom de {name}.", "Identity card {id}, holder {name}.",
    "Le relevé porte {id} deux fois.", "Selon le relevé, {id} figure deux fois.", "The log shows {id} twice.", "We found {id} in the export.", "The file lists {id} and {id}.",
    "{titled}, demeurant {address}, conteste la décision.", "{name}, demeurant {address}, a déposé une demande.", "{name}, living at {addresse}, disputes the notice.", "{titled}, residing at {addresse}, signed the form.",
    "Envoyer la copie chez {name}, {address}.", "Ship the copy to {name}, {addresse}.", "Deliver to {titled}, {addresse}.", "Adresse de correspondance : {address}.", "Mailing address: {addresse}.", "Adresse : {address}", "Address: {addresse}",
    "La visite aura lieu au {address}.", "The visit takes place at {addresse}.", "Le rendez-vous est fixé {address}.", "Il habite {address}, depuis {year}.", "{name} {did}.", "{name} {diden}.", "Hier, {name} {did} au guichet.", "On a dit que {name} {did}.", "They say {name} {diden} twice.", "La copie remise à {name} {did2}.", "A note for {name} came back.", "un courrier reçu de {name} hier", "{name} ({email}) {did}.",
    "Mon numéro ({id}) figure au dossier.", "my number is {id}, keep it safe", "Son numéro de sécurité sociale ({id}) est exact.", "Le numéro {id} est le mien.", "social security number {id}, tax id {id}", "passport number {id} belongs to {name}", "Contactez {email} pour en savoir plus.", "par mail ({email}) ou au {phone}",
    "You can reach me at {email} any time.", "Il vit au {address}.", "Passer au {address} avant midi.", "Rendez-vous {address}.", "Venir au {address}", "domicilié au {address},", "Colis à déposer {address} ce soir.", "{address}", "{addresse}", "Son courrier arrive à {addresse}.", "mon adresse est {address}, merci", "She moved to {addresse} last May.",
    "{name} a présenté le rapport.", "{name} a pris la parole.", "{name} presented the report.", "{name} joined the meeting late.", "la demande, selon {name}, reste à vérifier", "the request, says {name}, remains open.",
    "le montant, d'après {titled}, est exact", "Selon {name}, la décision est prise.", "According to {name}, the change is safe.", "proposé par {name} et validé par {name}", "reviewed by {name} and merged by {name}",
    "Merci à {name} pour sa relecture.", "Thanks to {name} for the review.", "une lettre de {name} du {date}", "as {name} wrote in {year},", "Le compte de {name} est clos.", "{titled} remplace {titled} à partir du {date}.",
    "L'avis de {name} ( {email} ) est joint.", "Madame {name} et Monsieur {name} sont convoqués.", "Cher {name}, votre dossier est complet.", "Dear {name}, your file is complete.", "Je soussigné {name} certifie le relevé.",
]
NEGATIVE = [
    "La société {company} SA reprend le contrat annuel.", "La société {company} a été dissoute.", "{company} Ltd takes over the contract.", "Le siège de {company} se trouve à {town}.", "{company} moved its office to {town}.",
    "{company} a déménagé à {town}.", "The head office of {company} is in {town}.", "La Direction des Affaires Générales et l'Agence {company} publient le barème.", "The Eastern Planning Board and the {company} Agency publish the table.",
    "The {company} Agency and the Central Records Office agree.", "Le Ministère des Finances publie le barème.", "Le bureau de la rue {of} est fermé.", "La rue {of} est barrée.", "The office in {ename} {estreet} is closed.", "Traffic on {ename} {estreet} is slow.",
    "Référence comptable {ledger}, lot {small}.", "Ledger reference {ledger}, lot {small}.", "Facture {ledger} du {date}.", "Invoice {ledger} of {date}.", "La loi n° {year}-{n4} du {dateslash} fixe le taux.", "Act {year}-{n4} of {dateslash} sets the rate.",
    "Montant arrêté à {amount} euros au {datespace}.", "The total is {amount} as of {datespace}.", "un total de {amount} euros au {datespace}", "dans la limite de {amount} euros.", "Le paquet outil@{v} remplace @cache_unit.", "Package tool@{v} replaces @cache_unit.",
    "pip install outil@{v}", "Voir le ticket TCK-{n5} et le commit {hex}.", "See ticket ABC-{n5} and commit {hex}.", "en application de l'article L. {n4} bis.", "l'article R. {n3}-{small} et l'article L. {n4}", "Article L. {n4}-{small}",
    "à compter du {date} pour {small} % du montant.", "before January {year} within {n3} seconds.", "with {small} retries per item before May {year}. Each worker waits.", "depuis mars {year}. Toutefois, le contrat reste.", "within {n3} seconds. When idle, the cache waits.",
    "@staticmethod", "@register('module')", "def load_table(path, cache=None):", "x = [[{small}, {small}], [row.value, {small}]]", "return build_index(name, {n4})", "{n5} {town}", "{n5} {town}.", "Fait à {town}, le {date}.", "In {town}, on {date}.",
    "{n3};{n4};{n4}", "total;{n3};{n5}", "- Le seuil annuel du contrat {small}", "{small}. Le Seuil Annuel Du Contrat", "The Lazy Parser And Its Queue", "LE SEUIL ANNUEL DU CONTRAT", "Le Tribunal Administratif a statué le {date}.",
    "La Cour de Cassation rejette le pourvoi.", "The Supreme Court held on {date} that", "Version {v} du {date}.", "L'imprimante HP LaserJet {n4} est en panne.", "Windows {small} et Linux {v} sont pris en charge.", "Chapitre {small}. Dispositions générales",
    "La Banque Centrale et la Caisse {company} ont signé.", "Open Source Initiative and World Wide Web groups met.", "Le Grand Prix {company} aura lieu à {town}.", "Le {n3} rue", "ISBN {isbn}", "IP 192.168.{small}.{small}", "le code {n5} du catalogue",
    "Pour mémoire, le lot {n3} compte {small} pièces de {n3} grammes.", "In this mode, 3 workers handle {n5} rows.", "Monsieur le Président ouvre la séance.", "Madame la Directrice signe.", "The Director signs the note.",
    "en application de l'article {n4} A. Le taux annuel reste fixe.", "selon l'article L. {n3} A. Une part du montant est due.", "de l'article R. {n4} B. En outre, le seuil baisse.", "au titre de l'article {n3} A. Par exception, la part est nulle.",
    "{company} Systems Ltd took over the contract.", "{company} Systems Ltd takes over.", "{company} Group Inc signed.", "Le groupe {company} Industries SAS a signé.", "{company} Services Ltd and {company} Holding SA merged.",
    "La Direction des {many} {many} et l'Agence {company} publient le barème.", "La Direction des {many} {many} publie le barème.", "Le Service des {many} {many} et la Caisse {company} sont saisis.", "la Commission des {many} {many} et l'Office {company} se réunissent.",
    "The {many} {many} Board and the {company} Agency publish the table.", "The Office of {many} {many} and the {company} Agency agree.", "le Bureau des {many} {many} répond.",
    "en application de l'article {n3} bis, même si la période reste ouverte.", "en application de l'article L. {n4} ter, sauf si la dette est due.", "de l'article R. {n3} bis, dès lors que le seuil baisse.", "l'article L. {n4} A. Toutefois, le taux reste fixe.",
    "en application de l'article {n4} A. Toutefois, une part est due.", "au sens de l'article {n4} B. Cependant, la règle est nulle.", "l'article {n4} C. Néanmoins, le montant est exact.", "the queue {company} drains; a {company} unit, living in memory, waits.",
    "La société {company} {did}.", "{company} Ltd {diden}.", "L'agence {company} {did}.", "Le Conseil Municipal {did}.", "la Chambre Régionale {did}.", "Toutefois, le service {did}.", "The Board {diden}.", "Le Comité de Bassin {did}.", "Le Conseil {many} et la Chambre {many} {did2}.", "Numéro de lot ({ledger}) inconnu.",
    "La version ({v}) manque.", "Le Code de Procédure {did2}.", "Article {n4} bis : la taxe est due.",
    "Le compte {amount} euros est clos au {datespace}.", "La commande {n5}-{n4} part de {town} vers {town}.",
]
#: Kinds of the spans, in the order of their tags.
KINDS = ("name", "address", "email", "phone", "id_number")


class _Fill:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def invented(self) -> str:
        return ("".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 2))) + self.r.choice(ENDS)).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def grouped(self, *sizes: int, sep: str = " ") -> str:
        return sep.join(self.digits(k) for k in sizes)

    def number(self) -> int:
        return self.r.randint(*self.r.choice([(1, 9), (10, 99), (100, 990)]))

    def name(self) -> str:
        r = self.r
        one = lambda pool: self.invented() if r.random() < 0.6 else r.choice(pool)
        first, last = one(FIRST), one(LAST)
        if r.random() < 0.15:
            first += "-" + one(FIRST)
        if r.random() < 0.15:
            last += "-" + one(LAST)
        style = r.random()
        if style < 0.16:
            return f"{first} {last.upper()}"
        if style < 0.30:
            return f"{last.upper()} {first}"
        if style < 0.36:
            return f"{first[0]}. {last}"
        if style < 0.38:
            return f"{first[0]}.-{r.choice('ACEJLMP')}. {last}"
        if style < 0.46:
            return f"{first} {r.choice('ABCDEFGHIJLMNOPRST')}. {last}"
        if style < 0.56:
            return f"{first} {r.choice(['de', 'de la', 'du', 'van', 'von', 'Le'])} {last}"
        if style < 0.63:
            return f"{first.upper()} {last.upper()}"
        return f"{first} {last}"

    def email(self) -> str:
        r = self.r
        local = r.choice(["{a}.{b}", "{a}_{b}", "{b}{n}", "{a}-{b}", "{c}{b}", "{a}+{b}", "{B}.{a}"]).format(a=self.invented().lower(), b=self.invented().lower(), B=self.invented().upper(), c=r.choice("abcdefg"), n=r.randint(1, 99))
        parts = [r.choice(DOMAIN)] + ([r.choice(DOMAIN)] if r.random() < 0.3 else []) + [r.choice(["fr", "com", "org", "example", "test", "invalid", "net"])]
        style = r.random()
        if style < 0.7:
            return f"{local}@{'.'.join(parts)}"
        if style < 0.8:
            return f"{local} @ {'.'.join(parts)}"
        if style < 0.88:
            return f"{local} {r.choice(['(arobase)', '(at)', '[arobase]', 'arobase'])} {'.'.join(parts)}"
        if style < 0.93:
            return f"{local} {r.choice(['AT', '(at)', 'arobase'])} {r.choice([' DOT ', ' (dot) ', ' [point] ']).join(parts)}"
        return f"{local} [at] {' [dot] '.join(parts)}"

    def phone(self) -> str:
        r = self.r
        p = r.choice(["04", "01", "06", "07", "02", "09"])
        two = [self.digits(2) for _ in range(4)]
        return r.choice([
            p + "".join(two), " ".join([p, *two]), ".".join([p, *two]), "-".join([p, *two]), f"+33 {p[1]} {' '.join(two)}", f"+33{p[1]}{''.join(two)}", f"0033 {p[1]} {two[0]} {two[1]} {two[2]}{two[3]}", f"+33 (0){p[1]} {' '.join(two)}",
            f"{self.digits(3)}-{self.digits(3)}-{self.digits(4)}", f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", f"{self.digits(3)}-{self.digits(4)}", f"07{self.digits(3)} {self.digits(6)}", f"+44 7{self.digits(3)} {self.digits(3)} {self.digits(3)}",
            f"020 {self.digits(4)} {self.digits(4)}", f"+1 {self.digits(3)} {self.digits(3)} {self.digits(4)}", f"+{self.digits(11)}",
        ])

    def id(self) -> str:
        r = self.r
        up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        nir = (r.choice("12"), self.digits(2), f"{r.randint(1, 12):02d}", self.digits(2), self.digits(3), self.digits(3), self.digits(2))
        return r.choice([
            " ".join(nir), "".join(nir), self.digits(13), self.grouped(2, 2, 3, 3, 3), self.digits(12), f"{self.digits(2)}{up(2)}{self.digits(5)}", self.grouped(3, 2, 4, sep="-"), f"{up(2)} {self.grouped(2, 2, 2)} {r.choice('ABCD')}",
        ])

    def address(self) -> str:
        r = self.r
        no = str(self.number()) + r.choice(["", "", "", " bis", " ter", ",", ",", " bis,"])
        street = f"{no} {r.choice(STREET_FR)} {r.choice(OF_FR)}"
        return street + r.choice(["", f", {self.digits(5)} {r.choice(TOWN)}", f" - {self.digits(5)} {r.choice(TOWN)}", f"\n{self.digits(5)} {r.choice(TOWN)}"])

    def addresse(self) -> str:
        r = self.r
        street = f"{self.number()}{r.choice(['', '', 'B'])} {r.choice(NAME_EN) if r.random() < 0.6 else self.invented()} {r.choice(STREET_EN)}"
        return street + r.choice(["", f", {r.choice(TOWN)}", f", {r.choice(TOWN)}, AB{r.randint(1, 9)} {r.randint(1, 9)}CD", f", {r.choice(TOWN)}, XY {self.digits(5)}"])

    def other(self, slot: str) -> str:
        r = self.r
        months = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
        return {
            "did": lambda: r.choice(["a répondu", "est venu", "ne travaille plus ici", "a refusé", "a vendu sa maison", "a signé hier", "est absent", "a été convoqué", "demande un délai", "a écrit deux fois"]),
            "diden": lambda: r.choice(["asked for time", "replied", "said no", "left early", "works here", "signed yesterday", "was called", "wants a copy", "has moved", "agreed"]), "did2": lambda: r.choice(["est valable", "est perdue", "manque", "suffit"]), "many": lambda: r.choice(PUBLIC) if r.random() < 0.6 else self.invented() + "s", "company": lambda: r.choice(COMPANY) if r.random() < 0.5 else self.invented(), "town": lambda: r.choice(TOWN), "of": lambda: r.choice(OF_FR), "ename": lambda: r.choice(NAME_EN), "estreet": lambda: r.choice(STREET_EN),
            "ledger": lambda: f"{r.randint(100, 899)}-{self.digits(2)}-{self.digits(4)}", "small": lambda: str(r.randint(1, 99)), "year": lambda: str(r.randint(1990, 2029)), "n3": lambda: str(r.randint(100, 999)), "n4": lambda: str(r.randint(1000, 1999)),
            "n5": lambda: self.digits(5), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(8)), "v": lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", "date": lambda: f"{r.randint(1, 31)} {r.choice(months)} {r.randint(1990, 2029)}",
            "dateslash": lambda: f"{r.randint(1, 31):02d}/{r.randint(1, 12):02d}/{r.randint(1990, 2029)}", "datespace": lambda: f"{r.randint(1, 31):02d} {r.randint(1, 12):02d} {r.randint(1990, 2029)}",
            "amount": lambda: r.choice([f"{r.randint(1, 9)} {self.grouped(3, 3, 3)}", f"{r.randint(10, 999)} {self.digits(3)}", f"{r.randint(1, 99)} {self.grouped(3, 3)}"]), "isbn": lambda: f"978-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}",
        }[slot]()


def examples(rows: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their spans (start, end, kind): sentences of both lists, up to three in a row."""
    f = _Fill(seed)
    for _ in range(rows):
        text, spans = "", []
        for _ in range(f.r.choice([1, 1, 2, 3])):
            template = f.r.choice(POSITIVE if f.r.random() < 0.6 else NEGATIVE)
            if text:
                text += f.r.choice([" ", " ", "\n", " Une remise partielle suspend le seuil. ", " the local cache waits. "])
            rest = template
            while "{" in rest:
                before, _, rest = rest.partition("{")
                slot, _, rest = rest.partition("}")
                text += before
                if slot == "titled":
                    text += f.r.choice(TITLE_FR + TITLE_EN) + " "
                    slot = "name"
                kind = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address", "addresse": "address"}.get(slot)
                value = getattr(f, slot)() if kind else f.other(slot)
                if kind:
                    skip = len(value) - len(value.lstrip("("))
                    spans.append((len(text) + skip, len(text) + len(value), kind))
                text += value
            text += rest
        yield text, spans
