"""Training messages written from templates: general wordings with graded severity, and harmless look-alikes.

A template is a kind, a severity and texts; ``{slot}`` stands for any word of that slot.  Each
text is written out a fixed number of times with slot words drawn by a seeded generator.
"""

from __future__ import annotations

import random
import re

SLOTS: dict[str, tuple[str, ...]] = {
    k: tuple(v.split("|"))
    for k, v in {
        "i": "I|we|I'm going to|I'm gonna|we're going to|someone should|I swear I'll|one day I'll|my brothers and I will",
        "harm": "kill|stab|shoot|strangle|choke|beat|punch|hurt|gut|skin|bury|slap|crush|murder|drown|cripple|poison|kick|smack|run over",
        "part": "throat|face|neck|teeth|legs|arms|fingers|skull|jaw|ribs|nose|kneecaps|head|knees|spine",
        "break": "slit|break|cut|smash|snap|crack|bash in|slice|rip out|knock out|stomp on",
        "home": "house|car|family|home|kids|shop|flat",
        "insult": "idiot|moron|loser|clown|imbecile|coward|creep|cretin|bastard|bitch|pig|snake|rat|fool|dunce|parasite|crybaby|liar|fraud|worm|scumbag|failure|halfwit|simpleton|muppet|tosser|git|airhead|lowlife|prick|jackass",
        "insults": "idiots|morons|losers|clowns|imbeciles|cowards|creeps|cretins|bastards|pigs|snakes|fools|liars|frauds|worms|scumbags|failures|halfwits|jackasses",
        "mean": "stupid|dumb|worthless|pathetic|useless|ugly|fat|disgusting|brainless|spineless|talentless|filthy|lazy|incompetent|repulsive|miserable|clueless|vile|ignorant|gutless",
        "group": "cripples|Jews|Muslims|Christians|Hindus|gays|lesbians|women|blacks|whites|Asians|Arabs|Africans|Mexicans|Poles|Turks|Romanians|Indians|Pakistanis|Chinese people|foreigners|immigrants|migrants|refugees|asylum seekers|gypsies|trans people|disabled people|old people|homeless people|Catholics|Russians|northerners|southerners|the islanders|the hill people|the newcomers|the natives|those people|Sikhs|Buddhists|Albanians|Somalis|Syrians",
        "vile": "vermin|animals|parasites|rats|cockroaches|subhuman|a disease|a plague|filth|savages|scum|maggots|leeches|monkeys|apes|a cancer|an infestation|pests|lice|swine|beasts",
        "bad": "thieves|criminals|rapists|terrorists|liars|cheats|murderers|invaders|drug dealers|welfare cheats|inferior|too stupid for school|born to steal|dirty|evil|the enemy|ruining this country|taking over",
        "out": "should be deported|must be eliminated|should be wiped out|must leave|do not belong here|should be locked up|must be stopped at any price|should be sterilised|should never have been let in|need to be removed|should be banned from our schools|must go|have no place here|should be shot at the border|don't deserve rights|should hang|should not be allowed into any team|should not be let near us|must not be let into offices|should never teach|are a burden and must go",
        "place": "our country|this town|our street|Europe|our schools|this city|our land|my neighbourhood|the village",
        "body": "tits|boobs|pussy|cock|dick|ass|nipples|hole|body|thighs|clit|butt|cunt|breasts",
        "lewd": "horny|wet|hard|naked|naughty|kinky|slutty|tight|dripping|aroused",
        "do": "fuck|lick|suck|ride|spank|bang|screw|kiss|touch|taste|mount|undress|finger|pound|sleep with",
        "media": "nudes|porn|naked pics|sex tape|nude photos|dirty videos|topless pictures|sex videos|hot clips",
        "thing": "server|printer|parser|build|laptop|script|cache|router|meeting|bus|process|index|test|coffee machine|thread|job|branch|report|phone|plan|release|deadline|query",
        "good": "lovely|great|kind|welcome|brilliant|friendly|hard-working|good|fine|fantastic|helpful",
        "act": "bake wonderful cakes|won the match|run a nice shop|opened a school|vote on sunday|play in the final|deserve equal rights|pay the same taxes|celebrate the new year|cook the best soup|moved in next door|helped after the flood|sing in the choir|work in the hospital",
        "food": "onions|rain|mondays|cold coffee|long meetings|merge conflicts|traffic|this song|flaky tests|paperwork",
        "when": "tonight|tomorrow|now|after work|this weekend|at noon|later",
        "number": "12|7|40|221|0:3|5.2|0664 123|twenty|1987|30303|no. 8",
        "street": "Mill Lane|Station Road|Church Street|Gartenweg 4|Oak Avenue|High Street|Park Row|the old harbour",
        "name": "Tom|Anna|Peter|Maria|the boss|your brother|that referee|our mayor|the new guy|she|he",
    }.items()
}

#: kind, severity, texts parted by |.
TEMPLATES = (
    ("abuse", 2, "{i} {harm} you|{i} {break} your {part}|you will die for this|I hope you die|I hope you get {mean} cancer|go {harm} yourself|you should {harm} yourself|{i} {harm} your {home}|I'll burn your {home} down|do the world a favour and end your life|kys|kill urself|please just die|you'd better hide, I know your address|I'm coming for you and your {home}|you won't live to see {when}|someone ought to {break} your {part}|I'd love to {harm} you|expect a knife in your {part}|next time I see you, you are dead|sleep with one eye open, {insult}|slit your wrists|you deserve a bullet"),
    ("abuse", 1, "you {insult}|you {mean} {insult}|you are a {mean} {insult}|you're such a {insult}|what a {mean} {insult}|you people are {insults}|{name} is a {mean} {insult}|{name} is a {insult} and everyone knows|listen, {insult}|shut up, {insult}|shut your mouth|shut your {mean} mouth|stfu|gtfo|go fuck yourself|fuck you|f u|screw you, {insult}|nobody likes you|no one wants you here|everyone hates you|the world is better without you|you make me sick|you disgust me|your mother should be ashamed of you|even a child understands this better than you|are you {mean} or what|how {mean} can you be|you have the brain of a {insult}|you're too {mean} to understand|you're nothing but a {insult}|get lost, {insult}|get out, {insult}|get out of here, {mean} {insult}|get out of {place}, {insult}|only a {insult} would do that|nobody would miss you|hey you {mean} {insult}|go away, nobody asked you|I despise you|you are an embarrassment|you are a disgrace|you look {mean}|you smell like garbage|your face makes me vomit|kiss my ass|eat shit|you worthless piece of garbage|typical {insult} answer from you|a {insult} like you cannot write code|ugh, you again, {mean} as ever|you'll never amount to anything"),
    ("hate", 2, "{group} are {vile}|{group} are nothing but {vile}|{group} are {vile} and {out}|kill all {group}|gas the {group}|death to {group}|{group} must be eliminated|{group} should be exterminated|wipe out {group}|burn {group} alive|{group} deserve to die|shoot {group} on sight|the only good {group} are dead {group}|let {group} drown|{vile}, that's what {group} are|hang {group}|hitler was right about {group}|purge {place} of {group}"),
    ("hate", 1, "{group} are {bad}|{group} are all {bad}|all {group} are {bad}|{group} {out}|{group} are invading {place}|keep {group} out of {place}|{group} out|get {group} out of {place}|{group} like that {out}|{group} like them {out}|people like these {group} {out}|I hate {group}|I don't want {group} in {place}|never trust {group}|send {group} back|no {group} in {place}|ban {group} from {place}|{group} are not real people|{group} are lazy and {bad}|{group} are {insults}|{group} can't be trusted with money|{group} don't belong in {place}|{group} have low intelligence|{group} are destroying {place}|{group} belong in the kitchen|{group} steal our jobs|say no to {group}|don't rent to {group}|don't hire {group}|stop {group} before they replace us"),
    ("sexual", 2, "I want to {do} you|I want to {do} your {body}|let me {do} your {body}|{do} me {when}|{do} my {body}|suck my dick|show me your {body}|send me your {media}|send {media}|my {body} needs you|your {body} makes me {lewd}|I'm so {lewd} for you|I'd {do} you all night|sit on my face|get on your knees and {do} me|daddy wants your {lewd} {body}|spread your legs|I masturbate thinking of you|I came thinking about you|cum on my {body}|free {media} here|watch {media} of {name}|{media} in my bio|selling {media}, dm me|sex cam, click here|who wants to {do} {when}|put it in my {body}|bend over and let me {do} you|I'm {lewd} and alone, come over|moan for me"),
    ("sexual", 1, "I want you naked|take off your clothes for me|what are you wearing under that|any {lewd} girls here|looking for sex {when}|sex {when}?|wanna have sex|wanna fuck|wanna fuck {when}|wanna {do} {when}|wanna fuck after the party|wanna {do} after the show|want to {do} after dinner|wanna come over and {do}|I'm {lewd}|feeling {lewd} {when}|let's make love|come to my bed|sleep with me|want to see me naked|hook up {when}, no strings|looking for a threesome|I dream of your {body}|undress slowly for me|I want to feel you inside me|you look so fuckable|nice {body}, baby|single and {lewd}"),
    ("none", 0, "the {thing} is {mean}|this {mean} {thing} again|that {insult} of a {thing} died|what a {mean} {thing}|the {thing} sucks|fuck this {thing}|damn {thing}|I hate {food}|{food} make me sick|I could kill for a coffee|the {thing} was killed|kill the {thing} first|{i} fix the {thing}|{i} break up the {thing} {when}|we will look at your {thing} {when}|you should restart the {thing}|can you check the {thing}|you are {good}|you are right|your {thing} is {good}|what a {good} {thing}|{name} is {good}|{name} is late {when}|see you {when}|we beat them in the final|you beat me by two points|my head hurts|I broke my arm|I cut my finger|he broke his leg on the ice|I'm dying of boredom|I'm so stupid, I forgot the {thing}|I feel ugly {when}|I was an idiot|my own mistake, I'm a {insult}|shut the door|shut down the {thing}"),
    ("none", 0, "{group} {act}|{group} {act} {when}|{group} are {good}|{group} are {good} neighbours|{group} are welcome in {place}|a law on the rights of {group}|a film about {group}|the history of {group} in {place}|thank {group} for the help|support {group} {when}|there are many {group} in {place}|{group} live in {place}|{group} came to {place} in 1950|{group} need better schools|he called {group} {vile}, that is not ok|a post that said {group} are {vile} was removed|nobody should call {group} {vile}|it is wrong to say {group} are {bad}|he was fined for shouting that {group} {out}|rats in the cellar|cockroaches in the kitchen again|the vermin are in the attic|animals need water|they were refugees once|the plague came in 1348|this disease is rare"),
    ("none", 0, "sex education starts {when}|the field sex is empty|breast cancer screening {when}|the doctor looked at my {part}|the doctor asked about sex|a talk about safe sex and condoms|naked eye|hard disk|it is hard to say|strip the spaces|a bare metal {thing}|the cat is wet|wet paint|lick the stamp|the dog licks my face|touch the screen|nude is a colour|they kissed at the wedding|we sleep with the window open|the movie has a nude scene|she breastfeeds the baby|sexual harassment is not allowed|porn sites are blocked at work|I want to see you {when}|I want to show you the {thing}|send me the {thing}|show me your {thing}|are you alone on the call|come over {when} for dinner|want to play {when}|dm me the {thing}|what are you wearing to the wedding"),
    ("none", 0, "he called me a {insult}|someone called me a {mean} {insult} and I reported it|please don't use the word {insult}|she was told to go {harm} herself, report that user|he wrote: you are a {insult}. that is bullying|stop calling people {insults}|the word {insult} is rude|in the book the villain says I will {harm} you|they threatened to {harm} him, call the police|hello|good morning|thanks a lot|ok {when}|lunch {when}?|the {thing} works again|any news on the {thing}|is the {thing} down|you and I should talk {when}|I love you all|you know the {thing} best|your turn|you're welcome|thank you for the {thing}|they left {place} {when}|people in {place} like the {thing}|old people use the tram|women and men play {when}|I'm in bed with a cold|my bed is broken|my {part} hurts"),
    ("none", 0, "my new number is {number}|call me on {number}|ring me at {number} {when}|text {number} if you are lost|mail me at {name} dot com|my mail is info at example dot org|reach me by mail {when}|write to me at the office|pick me up {when}|pick me up at {number} {street}|I live at {number} {street}|we moved to {street}|ship it to {street}, please|the old number is dead|my old phone is dead|the parcel goes to {street}|for the form: id {number}|my passport number is {number}|here you go, card {number}|order {number} has arrived|the order arrived broken|invoice {number} is paid|page {number} shows the {thing}|version {number} is out|the notes say the {thing} is fine|serial {number}|isbn {number} if you want the book|error {number} in the {thing}|host {number} is down|it costs {number} euros|anyone else seeing the {thing} hang?|anyone for coffee {when}?|anybody home?|can someone review my {thing} {when}|can someone help me with the {thing}|who broke the {thing}|who is on call {when}"),
    ("none", 0, "I owe {name} some money|ask {name}, they know the {thing}|{name} and {name} are late|{name} from sales called|thanks {name}|happy birthday {name}|{name} fixed the {thing}|is {name} in {when}|good morning from the lake|good night|greetings from the coast|the lake is lovely|I grew up around here|loved that film you lent me|loved the soup you made|liked that book you told me about|the bike you sold me is {good}|nice jacket, where did you buy it|we won by two goals {when}|I beat you at chess|they beat us by {number} points, next match {when}|our team lost again|half the street is without power|there is snow on {street}|the tram is late again|the weather is {good}|it rains again|lunch was soup|want some cake?|want to watch the match {when}?|wanna play chess {when}?|shall we meet {when}|will you come {when}|I will be late|I'm out {when}|my phone died, back {when}|back at noon|did the release, it looks odd now|the {thing} looks slow after the release|the {thing} runs slow on my old laptop|the {thing} needs a restart|the {thing} sucks at large files|I think the {thing} needs more memory|the {thing} killed its parent|it took forever|what was the name of that club?|what is your address|where do you live now|where is the {thing}|have you seen my keys|have you tried another {thing}|you can take my seat|you told me to wait|you left your jacket here|you wrote a {good} {thing}|I need your {thing} {when}|let me know {when}|let me show you the {thing}|lol|brb|haha, {good}"),
    ("abuse", 1, "halt die Klappe|du bist so dumm|du Arschloch|du bist ein Versager|verpiss dich|ferme ta gueule|espèce d'idiot|tu es nul|va te faire foutre|quel connard"),
    ("abuse", 2, "ich bring dich um|ich schlag dich tot|je vais te tuer|crève"),
    ("hate", 1, "Ausländer raus|Juden raus|les étrangers dehors|Flüchtlinge sind Verbrecher"),
    ("none", 0, "bitte halt kurz an|die Ausländer im Team sind nett|wo ist der Drucker|du bist nett|je suis en retard|bon appétit|tu es gentil|guten Morgen"),
)

#: Endings that say nothing about the kind: a case may be about any thing.
TAILS = ("about the {thing}", "after the {thing}", "because of the {thing}", "and your {thing}", "in the {thing} team", "before the {thing}", "{when}", "with that {thing}", "like the {thing}")

PER_TEXT = 8
_SLOT = re.compile(r"\{(\w+)\}")


def write_out(templates=TEMPLATES, per_text: int = PER_TEXT, seed: int = 7) -> list[tuple[str, int, str]]:
    """(kind, severity, message); texts without slots once, the others ``per_text`` times; most cases once more with a tail."""
    rng = random.Random(seed)
    out = []
    for kind, severity, texts in templates:
        for text in texts.split("|"):
            if kind != "none" and rng.random() < 0.6:
                out.append((kind, severity, _SLOT.sub(lambda m: rng.choice(SLOTS[m[1]]), f"{text} {rng.choice(TAILS)}")))
            drawn = {_SLOT.sub(lambda m: rng.choice(SLOTS[m[1]]), text) for _ in range(per_text if "{" in text else 1)}
            out += [(kind, severity, m) for m in sorted(drawn)]
    return out
