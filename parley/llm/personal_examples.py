"""Labelled sentence patterns and made-up values to which the personal-information model is fitted. All sentences are written for this purpose; none is taken from a table."""

from __future__ import annotations

import random
import re

# {name}, {email}, {phone}, {id}, {address} are filled and labelled; all other slots are filled and stay outside.
LABELLED = (
    # English
    "Hi, it's {name} here, I have a question about my bill.", "Good morning, this is {name}, I rang earlier today.", "I am {name} and my wife is {name}.", "Could you put me through to {name} in accounts?", "We met {name} at the branch on Monday.",
    "My neighbour {name} gave me your number.", "Please tell {name} that the parcel has arrived.", "The letter was addressed to {name} by mistake.", "According to {name} the claim was settled.", "I was told by {name} that it would take a week.",
    "Yes, speaking, {name}.", "{name} will pick it up tomorrow.", "{name} told us to wait.", "Dear {name}, we have received your request.", "Kind regards, {name}", "Thank you so much {name}, have a good day.", "Okay {name}, one moment please.", "So {name}, what can I do for you?",
    "My husband {name} and I share the account.", "Is this {name}?", "Am I talking with {name}?", "I discussed it with {name} last month.", "You can ask {name}, they know the case.", "The beneficiary is {name}, born in 1980.", "The account holder's name is {name}.", "Her name was {name}, I think.",
    "the caller's name is {name}", "please ask for {name} at the desk", "my daughter {name} has moved out", "The witness {name} signed on page three.", "Countersigned by {name} on {date}.", "I will let {name} know, thanks.", "{name} lives in {town} and works for {firm}.", "Doctor {name} sent the report.", "Let me transfer you to my colleague {name}.",
    "Her name is {name}, she holds the policy with me.", "It was {name} who called about the {plan}.", "I have been speaking to {name} from {firm}.", "You spoke with {name} from {town} the other day.",
    "Drop me a line at {email} when it is done.", "My new mail is {email}, please note it down.", "Reach us under {email} or by phone.", "Send it over to {email}, thanks.", "{email} is where the invoices should go.", "Is {email} still the right address?", "Could you forward that to {email} today?", "the e-mail is {email}",
    "I never got the link, I use {email} for everything.", "Mail me: {email}", "Write to {name} at {email} about it.", "I log in with {email} and it fails.", "the address on record, {email}, bounces",
    "You can call me on {phone} tomorrow.", "My mobile is {phone}, please try again later.", "Ring {phone} and ask for the manager.", "The best number for me is {phone}.", "Contact number: {phone}", "{phone} is my work phone.", "Please dial {phone} for support at home.", "Try {phone} instead, I am at home.", "it's {phone}, call any time",
    "office phone {phone}", "Reach me on {phone} or {phone}.", "I left a message for {name} on {phone}.", "text me at {phone} please", "his cell is {phone} I believe", "The line {phone} was busy all day.", "we can be reached at {phone}", "In the evening use {phone}, it is my landline.", "{phone} works best in the morning.", "Give me a ring: {phone}.",
    "My passport number is {id}.", "The social security number is {id}.", "National ID {id}, issued in {town}.", "My driving licence reads {id}.", "tax number {id}", "I was asked for my identity card, it is {id}.", "The ID on the document is {id}, please check it.", "The insurance number {id} belongs to my son.", "You will find {id} on the back of my residence permit.",
    "please verify {id}, it is my identity number", "Aadhaar {id} is linked already.", "My bank account IBAN is {id}.", "He read out {id} from his passport.", "Our personal identification is {id} for both of us.", "{id} is what my ID card says.", "As proof I can offer {id}, which is my tax id.",
    "Our address is {address}.", "Please deliver it to {address}, second door.", "I live at {address} since May.", "The flat at {address} is rented out.", "Send the letter to {address} by post.", "We have moved from {address} last year.", "{address} is my home address.", "My office is at {address}.", "the house at {address} was sold", "Come to {address} at noon.",
    "They sent everything to {address}, where I no longer live.", "deliver to {address} please", "Our new home in {address} is lovely.", "Is {address} the address you have?", "He grew up in {address} with his parents.", "It should be mailed to {address} and nowhere else.", "She is staying at {address} this month.", "Change the address to {address}.",
    # German
    "Guten Tag, hier spricht {name}.", "Ich heiße {name} und habe eine Frage.", "Mein Name lautet {name}.", "Können Sie mich mit {name} verbinden?", "Frau {name} hat mir das gestern erklärt.", "Vielen Dank {name}, bis morgen.", "Der Brief ging an {name}.", "Ich hatte mit {name} telefoniert.", "Mein Mann heißt {name}.", "Das ist {name} aus {town}.", "Gestern sprach ich mit {name} über den Fall.", "Danke {name}, das hilft mir.",
    "Meine neue Mailadresse lautet {email}.", "Bitte schicken Sie die Rechnung an {email}.", "Unter {email} bin ich immer erreichbar.", "{email} nutze ich für die Post der Bank.", "Meine Handynummer ist {phone}.", "Sie erreichen mich unter {phone}.", "Rufen Sie {phone} an, wenn es geht.", "Abends bin ich unter der Nummer {phone} zu sprechen.", "{phone} ist meine Nummer im Büro.",
    "Meine Steuernummer lautet {id}.", "Auf dem Reisepass steht {id}.", "Die Nummer meines Personalausweises ist {id}.", "Im Ausweis lese ich {id}.", "Wir wohnen {address}.", "Senden Sie das Paket an {address}.", "Meine Anschrift ist {address}.", "Seit Juni lebe ich in der Wohnung {address} allein.", "Ich bin nach {address} gezogen.", "Er wohnt in {address} mit Frau und Kind.",
    # French
    "Bonjour, ici {name}, je vous ai appelé hier.", "Mon nom est {name}.", "Je voudrais parler à {name}, s'il vous plaît.", "Madame {name} m'a déjà répondu.", "Merci beaucoup {name}, bonne journée.", "Mon mari s'appelle {name}.", "J'ai vu {name} à l'agence.", "C'est encore {name}, de {town}.", "J'ai discuté avec {name} hier soir.", "Merci {name}, c'est clair.", "Je m'appelle {name}, j'ai perdu ma carte.",
    "Mon adresse mail est {email}.", "Écrivez-moi à {email} demain.", "Envoyez le contrat à {email} ce soir.", "{email} est ma nouvelle adresse.", "Mon portable est le {phone}.", "Vous pouvez me joindre au {phone}.", "Appelez le {phone} après midi.", "Le {phone} est mon numéro au bureau.", "Mon numéro de passeport est {id}.", "Mon numéro fiscal est {id}.", "La carte d'identité porte le numéro {id}.", "J'ai noté {id} sur ma pièce d'identité.",
    "J'habite toujours {address}.", "Nous vivons au {address} depuis mars.", "Livrez le colis au {address}.", "Mon adresse est {address}.", "Il a déménagé à {address} avec ses enfants.",
    # Spanish
    "Buenos días, soy {name}.", "Mi nombre es {name} y tengo una duda.", "Quisiera hablar con {name}, por favor.", "La señora {name} ya me lo explicó.", "Muchas gracias {name}, hasta luego.", "Mi esposo se llama {name}.", "Ayer vi a {name} en la sucursal.", "Ayer estuve hablando con {name} del pago.", "Me llamo {name}, perdí mi tarjeta.", "Gracias {name}, queda claro.",
    "Mi correo es {email}.", "Escríbame a {email} mañana.", "Mande la factura a {email} hoy.", "{email} es el correo de mi trabajo.", "Mi móvil es el {phone}.", "Puede llamarme al {phone} hoy.", "El {phone} es mi número de casa.", "Mi pasaporte es {id}.", "El número de mi documento de identidad es {id}.", "En la cédula dice {id}.", "Mi número fiscal: {id}.",
    "Vivo cerca, en {address}.", "Mi dirección es {address}.", "Mande el paquete a {address}.", "Nos mudamos a {address} con los niños.", "Ella vive en {address} desde mayo.",
    # Portuguese
    "Bom dia, fala {name}.", "Chamo-me {name} e tenho uma dúvida.", "Meu nome completo é {name}.", "Queria falar com {name}, por favor.", "A senhora {name} já me explicou.", "Muito obrigada {name}, até logo.", "Vi {name} na agência ontem.", "Ontem conversei com {name} sobre a conta.", "Obrigada {name}, ficou claro.", "O nome do titular é {name} e mais ninguém.",
    "O meu e-mail é {email}.", "Escreva para {email} amanhã.", "Mande a fatura para {email} hoje.", "Uso {email} para tudo.", "O meu telemóvel é {phone}.", "Pode ligar para {phone} hoje.", "O {phone} é o número de casa.", "O meu passaporte é {id}.", "No documento de identidade está {id}.", "O número fiscal é {id}.", "O número da identidade dele é {id} e está certo.",
    "Moro sozinho em {address}.", "A minha morada é {address}.", "Mande a encomenda para {address}.", "Vivemos em {address} com os filhos.",
    # Hindi in Latin letters
    "Namaste, main {name} bol raha hoon.", "Mera poora naam {name} hai.", "Kya aap meri baat {name} se kara sakte hain?", "Unka naam {name} tha.", "Shukriya {name}, phir milenge.", "{name} ne kal phone kiya tha.", "Kal {name} se mulaqat hui thi.", "Dhanyavaad {name}, samajh gaya.", "Mera naam {name} hai, mujhe madad chahiye.",
    "Mera email {email} hai.", "Bill {email} par bhejiye.", "Aap {email} par likh sakte hain.", "Mera number {phone} hai.", "Aap {phone} par call kijiye.", "Shaam ko {phone} par baat karenge.", "Mera passport number {id} hai.", "Pehchaan patra par {id} likha hai.", "Aadhaar number {id} hai.", "Main {address} mein rehti hoon.", "Mera pata {address} hai.", "Parcel {address} par bhejiye.", "Hum {address} mein rehte hain.",
    # Hindi
    "नमस्ते, मैं {name} बोल रहा हूँ।", "मेरा पूरा नाम {name} है।", "क्या आप मेरी बात {name} से करा सकते हैं?", "शुक्रिया {name}, फिर मिलेंगे।", "{name} ने कल फ़ोन किया था।", "कल {name} से मुलाकात हुई थी।", "धन्यवाद {name}, समझ गया।", "मेरा ईमेल {email} है।", "बिल {email} पर भेजिए।", "मेरा नंबर {phone} है।", "आप {phone} पर कॉल कीजिए।", "शाम को {phone} पर बात करेंगे।",
    "मेरा पासपोर्ट नंबर {id} है।", "पहचान पत्र पर {id} लिखा है।", "आधार नंबर {id} है।", "मैं {address} में रहती हूँ।", "मेरा पता {address} है।", "पार्सल {address} पर भेजिए।", "हम {address} में रहते हैं।",
)
PLAIN = (
    "How long does a transfer to {firm} take?", "The {plan} costs {amount} a year.", "Our branch in {town} is closed on {date}.", "Your ticket {ref} has been updated.", "Please quote {ref} when you write to us.", "Invoice {ref} for {amount} is due on {date}.", "The order {ref} left our warehouse in {town}.",
    "Fill in form {form} and send it back.", "Interest of {pct} applies from {date}.", "The meeting starts at {time} in {town}.", "I paid {amount} to {firm} in {month}.", "We see a balance of {amount} on the {plan}.", "Case {ref} was closed at {time}.", "The train from {town} to {town} was late.", "{firm} raised its prices by {pct}.",
    "Welcome to {firm}, how can I help you?", "Thank you for calling {firm}, please hold the line.", "You are through to {firm}.", "{firm} will merge with {firm} next {month}.", "{plan} is our cheapest offer.", "I have been a client of {firm} since {year}.", "Does the {plan} cover accidents abroad?", "In {town} it rained all {month}.", "The {town} office moved to a bigger building.",
    "His mail is already [EMAIL] in our files.", "The customer [NAME] lives at [ADDRESS].", "The number was masked as ****{four}.", "My card ends in {four}.", "The last digits of the old card are {four}, it was blocked.", "A card with {four} at the end was found.", "The pin is not {four}.", "Hidden digits XX-{four} on the slip.", "The account XXXX {four} is masked.", "Enter the code {four} on the next screen.", "Version {version} of the app was released in {month}.", "Page {num} of {num} is missing.", "Batch {batch} was recalled.", "The serial number {batch} is on the box.",
    "Folio {folio} holds {num} units.", "Units were sold at {amount} on {date}.", "From {date} to {date} the service is down.", "We open at {time} and close at {time}.", "There is a road under repair near the office.", "The street was full of people.", "A long way to go, said the manager.", "What a nice place to live.", "Cross the square and turn left.",
    "The way the fee is charged is not clear.", "He took the road to success.", "No, I do not think so.", "Yes please, go ahead.", "One two three, testing the line.", "I counted seven or eight calls.", "Three of the five payments failed.", "Nine out of ten clients agree.", "Between two and four in the afternoon is fine.", "Will you mark the date in your diary?", "May I ask you something?", "I hope the rose garden is open in June.",
    "It is a matter of grace and faith.", "June was cold and so was May.", "The Rose fees are shown in the table.", "Will it be done in April?", "Will the fees go up in June?", "Does the Grace period end in June?", "See the Rose edition of the report.", "Our May figures and June figures differ.", "Mark the box and sign.", "the june report and the may report", "Bill the account by {date}.", "The bill was not paid in {month}.", "Can I pay the amount in {num} instalments?", "My son is {num} years old.", "The fee went from {amount} to {amount}.", "It took them {num} days.", "Reference {ref} is pending.", "Your application {ref} is with the {dept} team.", "The {dept} desk will review it.", "Ask the {dept} department in {town}.",
    "{month} is the last month of the offer.", "On Monday the Bank of {town} was closed.", "The euro fell against the dollar.", "Only French and German letters are accepted.", "Our {plan} and our {plan} are both open.", "Whoever buys the {plan} should read this first.", "Invest in {plan} before {month}.", "The {adj} {noun} is checked by the {dept} team.", "Without a {adj} {noun} we wait for the {noun}.", "No {noun} is due before the {noun} is signed.",
    "Two {adj} copies of the {noun} were sent.", "Every {adj} {noun} for the {plan} was sent twice.", "{firm} printed the {noun} again on {date}.", "If the {noun} is {adj}, call the {dept} cell.", "With {code} you pay a {noun} of {pct}.", "For {code} they charged {amount}.", "I like {code} better.", "What does {code} stand for?", "Section {num}, paragraph {num}: the {noun}.", "Request {ref} in {town} is waiting for a {noun}.",
    "See {code} and {code} for details.", "The total of {amount} includes {pct} tax.", "{date}: {amount} received.", "{time} call ended.", "Your transaction {longref} was declined.", "The tracking number is {longref}.", "order {longref} not found", "Receipt no. {longref} of {date}.", "Note: {noun} ends at {time}.", "Today at {time} the {noun} was {adj}.", "The agent said the {noun} is {adj}.",
    "It was hard to hear you.", "I will check that for you now.", "Sorry, can you repeat that?", "the {plan} is what i want", "we are in {town} now", "They asked about the {plan} and the {noun}.", "Is there a {firm} branch in {town}?", "I would rather have the {plan} than the {plan}.", "Our {town} team answers within {num} days.", "Please leave the {plan} as it is.",
    "Wie lange dauert die Überweisung an {firm}?", "Der {plan} kostet {amount} im Jahr.", "Unsere Filiale in {town} ist am {date} geschlossen.", "Die Rechnung {ref} ist fällig.", "Der Antrag {ref} liegt beim Team in {town}.", "Das Formular {form} fehlt noch.", "Am {date} um {time} beginnt die Sitzung.", "Ich habe {amount} bezahlt.", "Der Weg zum Büro ist weit.", "Die Straße war gesperrt.", "Auf diese Weise geht es nicht.",
    "Kann ich den Vertrag im {month} kündigen?", "Die Gebühr von {amount} gilt für den {plan}.", "Hat der Kunde das Konto in {town} eröffnet?", "Der Zins liegt bei {pct}.", "Das Ticket {ref} ist offen.", "Meine Frau fragt nach der Rendite.", "Die Bank hat am Montag offen.", "Im Büro von {firm} arbeiten {num} Leute.", "Bestellung {longref} wurde storniert.", "Vor drei oder vier Wochen war das noch anders.",
    "Das Konto endet mit dem Vertrag.", "Wir zahlen mit der Karte.", "Nach dem Gespräch mit dem Berater war alles klar.", "Es geht um den Ablauf bei der Anmeldung mit dem Handy.", "Das Geld für die Wohnung kommt vom Konto.", "Mit der Zusage endet die Frist.", "Ohne den Nachweis gibt es keine Auszahlung.", "Wann kommt der Brief mit der Karte?", "Die Frau am Schalter war nett.", "Der Mann sagt, die Frist läuft ab.", "Nach dem Urlaub prüfe ich die Abrechnung und die Quittung.", "Haben Sie Fragen zur Police, zum Beitrag oder zur Laufzeit?",
    "Combien de temps prend le virement vers {firm} ?", "Le {plan} coûte {amount} par an.", "L'agence de {town} est fermée le {date}.", "La facture {ref} est payée.", "Le dossier {ref} est à {town}.", "Remplissez le formulaire {form}.", "La rue était fermée hier.", "Le taux est de {pct} en {month}.", "J'ai payé {amount} à {firm}.", "Ma femme demande le prix du {plan}.", "La commande {longref} est annulée.", "Deux ou trois fois par an.",
    "¿Cuánto tarda la transferencia a {firm}?", "El {plan} cuesta {amount} al año.", "La oficina de {town} cierra el {date}.", "La factura {ref} está pagada.", "La solicitud {ref} sigue en {town}.", "Falta el formulario {form}.", "La calle estaba cerrada.", "El tipo es del {pct} en {month}.", "Pagué {amount} a {firm}.", "El pedido {longref} fue cancelado.", "Quiero saber más del {plan}.", "Dos o tres veces al año.",
    "Quanto tempo leva a transferência para {firm}?", "O {plan} custa {amount} por ano.", "A agência de {town} fecha em {date}.", "A fatura {ref} está paga.", "O pedido {ref} continua em {town}.", "Falta o formulário {form}.", "A rua estava fechada.", "A taxa é de {pct} em {month}.", "Paguei {amount} à {firm}.", "Quero saber mais sobre o {plan}.", "A encomenda {longref} foi cancelada.",
    "Paisa {firm} tak pahunchne mein kitna samay lagega?", "{plan} ka kharch {amount} hai.", "{town} ki shakha {date} ko band hai.", "Bill {ref} bhar diya gaya hai.", "Form {form} abhi baaki hai.", "Byaj dar {pct} hai.", "Order {longref} radd ho gaya.", "Sadak band thi.", "Maine {month} mein {amount} diye.", "Mujhe {plan} ke baare mein batayiye.", "Do ya teen din lagenge.", "Kya {town} mein daftar hai?",
    "{babble}", "{babble}", "{babble}", "{babble}", "{babble} {code} {babble}", "{babble} {amount} {babble}", "{babble} {plan} {babble}", "{babble} {town} {babble}", "{babble} {date} {babble}", "{babble}", "{babble}", "{babble}", "{babble}",
    "{firm} तक पैसा पहुँचने में कितना समय लगेगा?", "{plan} का खर्च {amount} है।", "{town} की शाखा {date} को बंद है।", "बिल {ref} भर दिया गया है।", "फ़ॉर्म {form} अभी बाकी है।", "ब्याज दर {pct} है।", "ऑर्डर {longref} रद्द हो गया।", "सड़क बंद थी।", "मुझे {plan} के बारे में बताइए।", "दो या तीन दिन लगेंगे।", "क्या {town} में दफ़्तर है?",
)

# General vocabulary from which values are made.
STREETS = "street road lane avenue drive court close way place crescent terrace gardens grove boulevard hill row walk square park rise mews parkway highway circle trail view marg gali nagar colony vihar".split()
HEADS = "north south old new high mill oak church station green king queen river spring lake elm cedar bridge market castle".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine", "de": "null eins zwei drei vier fünf sechs sieben acht neun", "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "pt": "zero um dois três quatro cinco seis sete oito nove", "hi": "shunya ek do teen char paanch chhe saat aath nau",
}
LEGAL = "Bank,Insurance,Assurance,Trust,Mutual,Group,Ltd,Inc,GmbH,Holdings,Partners,Capital,Fund,Company,Services,Logistics,Energy,Telecom".split(",")
PRODUCT = (
    "Plan,Account,Fund,Bond,Pension,Savings,Cover,Policy,Card,Loan,Index,Income,Growth,Choice,Select,Flex,Prime,Star,Anchor,Horizon,Compass,Summit,Harbour,Care,Life,Health,Home,Travel,Value,Future,Builder,Protect,Secure,Saver,Balance,Dividend,Equity,Global,Junior,Senior,Basic,Premium,Classic,Term,Family,Gold,Silver,Liquid,Cash".split(",")
)
NOUNS = "fee charge claim refund payment premium form letter contract invoice receipt statement deposit transfer balance notice signature report limit rate".split()
ADJECTIVES = "late early open final annual monthly partial missing pending signed unpaid higher lower revised second".split()
DEPARTMENTS = "sales billing claims support audit product legal onboarding quality payments records".split()
MONTHS = "January February March April May June July August September October November December".split()
MARKS = ("", "", "", "", "", "", "[00:{d2}:{d2}] ", "Speaker {d1}: ", "Agent: ", "Um, ", "Uh ", "Well, ", "(laughs) ", "Customer >> ", "{d2}:{d2} ", "Hmm, ", "So, ", "- ", "Uh, you know, ", "[music] ")


class Values:
    """Fills the slots of the patterns with made-up values; a seed gives the same values again."""

    def __init__(self, names: dict[str, str], seed: int) -> None:
        self.r = random.Random(seed)
        self.given = sorted(k for k, v in names.items() if v == "given") or ["anna", "peter"]
        self.family = sorted(k for k, v in names.items() if v == "family") or ["miller", "kramer"]

    def made(self, least: int = 2) -> str:
        """A made-up word of syllables."""
        r = self.r
        return "".join(r.choice(("b", "br", "ch", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w", "z")) + r.choice("aeiou") for _ in range(r.randint(least, 3))) + r.choice(("", "n", "r", "l", "s", "nd", "rt", "m", "x", "ck"))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def upper(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def proper(self) -> str:
        return self.made().capitalize()

    def town(self) -> str:
        r = self.r
        return r.choice((self.proper(), self.proper(), self.proper(), f"{r.choice(HEADS).title()} {self.proper()}", self.proper() + r.choice(("ton", "burg", "ville", "ford", "pur", "berg"))))

    def firm(self) -> str:
        r = self.r
        return r.choice((f"{self.proper()} {r.choice(LEGAL)}", f"{self.proper()} {r.choice(LEGAL)}", f"{self.proper()} & {self.proper()}", f"{self.proper()} {self.proper()} {r.choice(LEGAL)}", f"{self.proper()} {r.choice(PRODUCT)} {r.choice(LEGAL)}"))

    def plan(self) -> str:
        r = self.r
        return r.choice((f"{self.proper()} {r.choice(PRODUCT)}", f"{self.proper()} {r.choice(PRODUCT)} {r.choice(PRODUCT)}", f"{r.choice(PRODUCT)} {r.choice(PRODUCT)}", f"{self.proper()} {r.choice(PRODUCT)} {self.proper()}", f"{self.proper()} {self.proper()} {r.choice(PRODUCT)}"))

    def babble(self) -> str:
        """A sentence of unknown words, some of them capitalised as German nouns are, among words of the other sentences."""
        r, out = self.r, []
        german = r.random() < 0.3
        words = [w for w in re.sub(r"\{\w+\}|[^\w\s]", " ", r.choice(PLAIN)).split() if not w[0].isdigit()] or ["and"]
        for _ in range(r.randint(3, 9)):
            w = r.choice(words) if r.random() < 0.4 else self.made(1)
            if german and r.random() < 0.4:
                out += [r.choice("der die das den dem ein eine einen mein meine unser im am vom zum".split()), w.capitalize()]
            else:
                out.append(w.lower())
        return (out[0].capitalize() + " " + " ".join(out[1:]) + r.choice((".", ".", "?", ""))).strip()

    def code(self) -> str:
        return self.r.choice((self.upper(self.r.randint(2, 4)), self.proper() + self.proper()))

    def name(self) -> str:
        r = self.r
        family = (r.choice(self.family) if r.random() < 0.45 else self.made()).title()
        given = (r.choice(self.given) if r.random() < 0.7 else self.made()).title()
        whole = r.choice((f"{given} {family}",) * 4 + (f"{given} {family}-{self.proper()}", f"{given}-{self.proper()} {family}", f"{given[0]}. {family}", f"{family.upper()} {given}", family, given, given, f"{given} {r.choice(('de', 'van', 'von', 'da'))} {family}", f"{given} {self.upper(1)}. {family}"))
        return whole.lower() if r.random() < 0.06 else whole

    def email(self) -> str:
        r = self.r
        a, b = (r.choice(self.given) if r.random() < 0.5 else self.made()), (r.choice(self.family) if r.random() < 0.5 else self.made())
        local = r.choice((f"{a}.{b}", f"{a}_{b}", f"{a}{b}", f"{a}{self.digits(2)}", f"{b}{self.digits(2)}", f"{b}{self.digits(r.randint(1, 4))}", f"{a}-{b}+{self.made()}", f"{a[0]}.{b}", f"{a}-{b}", f"{b}+{self.made()}", f"{a[0]}_{b}", f"{a}.{b}{self.digits(1)}", a))
        domain = self.made() + r.choice((".com", ".org", ".net", ".example", ".test", ".co.uk", ".de", ".in", f".{self.made()}.example", f".{self.made()}.com"))
        if r.random() < 0.3:
            at, dot = r.choice((("at", "dot"), ("at", "dot"), ("at", "dot"), ("at", "punkt"), ("arroba", "punto"), ("arroba", "ponto"), ("arobase", "point")))
            spoken = lambda s: s.replace(".", f" {dot} ").replace("_", " underscore ").replace("-", " dash ").replace("+", " plus ")
            return f"{spoken(local)} {at} {spoken(domain)}"
        whole = f"{local}@{domain}"
        return r.choice((whole,) * 5 + (whole.upper(), whole.upper(), f"{local} @ {domain}", f"{local}(at){domain}", f"{local} [at] {domain}"))

    def spelt(self, number: str) -> str:
        r = self.r
        words = DIGIT_NAMES[r.choice(("en", "en", "en", "de", "fr", "es", "pt", "hi"))].split()
        out = [words[int(c)] for c in number]
        if words[0] == "zero" and words[1] == "one" and r.random() < 0.5:
            out = ["oh" if w == "zero" else w for w in out]
            for k in range(len(out) - 1):
                if out[k] and out[k] == out[k + 1]:
                    out[k], out[k + 1] = "double " + out[k], ""
        return r.choice((" ", " ", " ", ", ", "-")).join(w for w in out if w)

    def phone(self) -> str:
        d, r = self.digits, self.r
        if r.random() < 0.22:
            return self.spelt(r.choice(("0", "0", "", "7")) + d(r.randint(7, 10)))
        return r.choice((
            f"0{d(4)} {d(6)}", f"0{d(10)}", f"0{d(10)}", f"0{d(9)}", d(10), f"+{d(2)} {d(4)} {d(6)}", f"00{d(2)}.{d(4)}.{d(3)}.{d(3)}", f"(0{d(2)}) {d(4)} {d(4)}", f"0{d(2)} {d(8)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}",
            f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} {d(5)} {d(5)}", f"+{d(2)} {d(2)} {d(7)}", f"+{d(11)}", f"{d(3)}-{d(4)}", f"{d(5)} {d(5)}", f"0{d(3)}/{d(6)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}-{d(7)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(4)}",
        ))

    def id(self) -> str:
        d, r, up = self.digits, self.r, self.upper
        mixed = up(5) + d(4) + up(1)
        return r.choice((
            f"{d(4)} {d(4)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", mixed, mixed, " ".join(mixed), up(1) + d(7), up(2) + d(7), f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{up(2)}{d(6)}{up(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}",
            up(2) + d(2) + " " + " ".join(d(4) for _ in range(r.randint(3, 5))) + f" {d(2)}", f"{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}", f"{d(8)}{up(1)}", f"{d(2)}/{d(3)}/{d(5)}", d(11), d(12), " ".join(d(9)), " ".join(d(12)), f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", self.spelt(d(r.randint(8, 12))),
        ))

    def address(self) -> str:
        r, d = self.r, self.digits
        stem = lambda: r.choice((self.proper(), self.proper(), r.choice(HEADS).title()))
        n = r.choice((str(r.randint(1, 2400)), str(r.randint(1, 190)), f"{r.randint(1, 90)}{r.choice('abcAB')}", f"{r.randint(1, 190)}/{r.randint(1, 9)}"))
        english = f"{stem()} {r.choice(STREETS).title()}"
        german = f"{self.proper()}{r.choice(('straße', 'strasse', 'weg', 'gasse', 'platz', 'allee', 'ring', 'damm'))}"
        romance = f"{r.choice(('rue', 'avenue', 'place', 'boulevard', 'Calle', 'Avenida', 'Plaza', 'rua', 'Rua', 'travessa', 'via', 'Via', 'chemin'))} {r.choice(('', '', 'de ', 'du ', 'da ', 'del '))}{self.proper()}"
        zipped = f"{d(5)} {self.town()}"
        spelt = f"{r.choice(TENS)} {r.choice(DIGIT_NAMES['en'].split()[1:])}" if r.random() < 0.6 else r.choice(DIGIT_NAMES["en"].split()[1:] + ["ten", "eleven", "twelve", "fifteen", "one hundred"])
        whole = r.choice((
            f"{n} {english}", f"{n} {english}, {self.town()}", f"{n} {english}, {self.town()}", f"{n} {english}, {self.town()} {d(5)}", f"{n} {english}, {r.randint(1, 9)}{r.choice(('st', 'nd', 'rd', 'th'))} floor, {self.town()}", f"Flat {r.randint(1, 30)}{r.choice('ABC ').strip()}, {n} {english}, {self.town()}",
            f"Apartment {r.randint(1, 90)}, {english}, {self.town()}", f"{german} {n}", f"{german} {n}, {zipped}", f"{german} {n} in {self.town()}", german, f"{n} {romance}", f"{n}, {romance}, {zipped}", f"{romance} {n}", f"{romance} {n}, {self.town()}", f"{romance}, {self.town()}", romance,
            english, f"{english}, {self.town()}", f"{spelt} {english}", f"{spelt} {english}, {self.town()}", f"House {r.choice(('No. ', 'no ', ''))}{n}, {english}, {self.town()}", f"House No. {n}, {english}, near the {stem()} Gate, {self.town()}", f"Plot {n}, {english}, {self.town()} {d(6)}", f"{n} {english}, near {stem()} Park", f"{n} {stem()} {english}, {self.town()}",
        ))
        if r.random() < 0.1:
            whole = whole.replace(",", "")
        return whole

    def date(self) -> str:
        r, d = self.r, self.digits
        y, m, day = r.randint(1980, 2026), r.randint(1, 12), r.randint(1, 28)
        return r.choice((f"{y}-{m:02d}-{day:02d}", f"{day:02d}/{m:02d}/{y}", f"{day:02d}.{m:02d}.{y}", f"{day} {r.choice(MONTHS)} {y}", f"{r.choice(MONTHS)} {day}", f"{day:02d}.{m:02d}.{y}"))

    def amount(self) -> str:
        r, d = self.r, self.digits
        n = r.choice((str(r.randint(1, 999999)), f"{r.randint(1, 999)},{d(3)}", f"{r.randint(1, 99999)}.{d(2)}", f"{r.randint(1, 99)},{d(2)},{d(3)}"))
        return r.choice((f"{n} USD", f"INR {n}", f"{n} EUR", f"€{n}", f"₹{n}", f"${n}", f"£{n}", f"Rs {n}", f"{n} dollars"))

    def slot(self, kind: str) -> str:
        r, d, up = self.r, self.digits, self.upper
        made = {
            "ref": lambda: r.choice((f"{up(r.randint(2, 3))}-{d(r.randint(4, 8))}", f"{up(3)} {d(r.randint(5, 10))}", f"#{d(6)}", f"{up(2)}{d(6)}", f"{up(1)}-{d(5)}")),
            "longref": lambda: r.choice((str(r.randint(1, 9)) + d(r.randint(7, 12)), f"{d(3)}-{d(7)}-{d(7)}", up(2) + d(9), f"{d(5)} {d(5)}")),
            "form": lambda: f"{up(1)}-{d(2)}", "pct": lambda: r.choice((f"{r.randint(0, 19)}.{d(1)}%", f"{r.randint(1, 40)}%", f"{r.randint(1, 9)},{d(1)} %")), "time": lambda: r.choice((f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"{r.randint(1, 12)} pm")),
            "month": lambda: r.choice(MONTHS), "year": lambda: str(r.randint(1980, 2026)), "four": lambda: d(4), "version": lambda: f"{r.randint(1, 12)}.{d(r.randint(1, 4))}.{d(1)}", "num": lambda: str(r.randint(1, 120)), "batch": lambda: "-".join((d(5), d(4), d(4))) if r.random() < 0.5 else d(8) + up(1),
            "folio": lambda: f"{d(6)}/{d(2)}", "dept": lambda: r.choice(DEPARTMENTS), "adj": lambda: r.choice(ADJECTIVES), "noun": lambda: r.choice(NOUNS), "d1": lambda: str(r.randint(1, 9)), "d2": lambda: f"{r.randint(0, 59):02d}",
        }
        return made[kind]()


SLOT = re.compile(r"\{(\w+)\}")
TYPE_OF = {"id": "id_number", "name": "name", "email": "email", "phone": "phone", "address": "address"}


def rows(names: dict[str, str], n: int, seed: int = 5, labelled: tuple[str, ...] = LABELLED, plain: tuple[str, ...] = PLAIN) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled sentences: (text, [(start, end, type)]); a fifth in lower case."""
    v, out = Values(names, seed), []
    for k in range(n):
        text, gold, at = "", [], 0
        pattern = v.r.choice(MARKS) + v.r.choice(labelled if k % 5 < 3 else plain)
        for m in SLOT.finditer(pattern):
            text += pattern[at : m.start()]
            kind = m[1]
            value = getattr(v, kind)() if hasattr(v, kind) else v.slot(kind)
            if kind == "name" and v.r.random() < 0.15:
                text += v.r.choice(("Mr. ", "Dr. ", "Mrs ", "Ms. ", "Herr ", "Frau ", "M. ", "Mme ", "Sr. ", "Shri "))
            if kind in TYPE_OF:
                gold.append((len(text), len(text) + len(value), TYPE_OF[kind]))
            text += value
            at = m.end()
        text += pattern[at:]
        if v.r.random() < 0.15 and len(text) == len(text.lower()):
            text = text.lower()
        out.append((text, gold))
    return out
