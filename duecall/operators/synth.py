"""Gold records made from templates, reproducibly.

Every choice is a hash of the record's key, so a rerun, or a task that is repeated after a lost
executor, makes the same record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.vocabulary import (
    GOLD_AMOUNTS,
    GOLD_FIRST_DAY,
    GOLD_LAST_DAY,
    GOLD_REMARKS,
    SCENARIO_TRUTH,
    SCENARIO_WEIGHTS,
)

# Our own wording; callers pass theirs as {language: {scenario: text}}.
TEMPLATES = {
    "english": {
        "PTP": "Agent: When will you clear the dues? Borrower: {amount} rupees on {date}, surely.",
        "PAID": "Agent: An instalment is open. Borrower: It went out of my account last week.",
        "WRONG_NUMBER": "Agent: Is this Meera? Borrower: Nobody of that name uses this phone.",
        "DENIED": "Agent: The loan is overdue. Borrower: I lost my work, there is no money.",
        "VISIT": "Agent: How will you settle it? Borrower: Let someone come by, I keep cash ready.",
    },
    "hindi": {
        "PTP": "Agent: Kist kab aayegi? Borrower: {date} tak {amount} rupaye bhej dunga.",
        "PAID": "Agent: Kist baaki hai. Borrower: Pichhle hafte hi khaate se kat gayi.",
        "WRONG_NUMBER": "Agent: Meera ji hain? Borrower: Is naam ka yahan koi nahi.",
        "DENIED": "Agent: Loan baaki hai. Borrower: Kaam chhoot gaya, paise nahi hain.",
        "VISIT": "Agent: Kaise chukayenge? Borrower: Kisi ko ghar bhejo, nakad rakha hai.",
    },
    "marathi": {
        "PTP": "Agent: Hapta kadhi yeil? Borrower: {date} la {amount} rupaye nakki pathavto.",
        "PAID": "Agent: Hapta rahila aahe. Borrower: To magchya athavdyat khatyatun gela.",
        "WRONG_NUMBER": "Agent: Meera tai aahet ka? Borrower: Ya navacha ithe koni nahi.",
        "DENIED": "Agent: Karja thakla aahe. Borrower: Kaam gela, paise nahit.",
        "VISIT": "Agent: Kase bharnar? Borrower: Konala ghari pathva, rokh tayar aahe.",
    },
    "gujarati": {
        "PTP": "Agent: Hapto kyare aavse? Borrower: {date} na roj {amount} rupiya chokkas mokli daish.",
        "PAID": "Agent: Hapto baaki chhe. Borrower: E to gaya athvadiye khata mathi kapai gayo.",
        "WRONG_NUMBER": "Agent: Meera ben chhe? Borrower: Aa naam nu ahi koi nathi.",
        "DENIED": "Agent: Loan chadhi gayi chhe. Borrower: Kaam chhuti gayu, paisa nathi.",
        "VISIT": "Agent: Kevi rite bharsho? Borrower: Koi ne ghare moklo, rokda taiyar chhe.",
    },
    "punjabi": {
        "PTP": "Agent: Kisht kadon aavegi? Borrower: {date} nu {amount} rupaye pakka bhej devanga.",
        "PAID": "Agent: Kisht baaki hai. Borrower: Oh pichhle hafte khaate vichon kat gayi si.",
        "WRONG_NUMBER": "Agent: Meera ji ne? Borrower: Is naa da ithe koi nahi.",
        "DENIED": "Agent: Karza baaki hai. Borrower: Kam chhut gaya, paise nahi haige.",
        "VISIT": "Agent: Kiven bharoge? Borrower: Kise nu ghar bhejo, nakad rakhya hai.",
    },
    "bengali": {
        "PTP": "Agent: Kisti kobe asbe? Borrower: {date} tarikhe {amount} taka pathiye debo.",
        "PAID": "Agent: Kisti baki ache. Borrower: Oi taka gato saptahe khata theke kete giyeche.",
        "WRONG_NUMBER": "Agent: Meera achen? Borrower: Ei naame ekhane keu nei.",
        "DENIED": "Agent: Rin baki pore ache. Borrower: Kaaj chole geche, taka nei.",
        "VISIT": "Agent: Kibhabe shodh korben? Borrower: Kauke bari pathan, nagad rakha ache.",
    },
    "tamil": {
        "PTP": "Agent: Thavanai eppo varum? Borrower: {date} andru {amount} rubai kandippa anuppuven.",
        "PAID": "Agent: Oru thavanai baaki. Borrower: Adhu pona vaaram kanakkil irundhu poivittadhu.",
        "WRONG_NUMBER": "Agent: Meera irukkangala? Borrower: Andha peril inge yaarum illai.",
        "DENIED": "Agent: Kadan thavari vittadhu. Borrower: Velai poyirichu, panam illai.",
        "VISIT": "Agent: Eppadi kattuveenga? Borrower: Yaaraiyavadhu veettukku anuppunga, rokkam irukku.",
    },
    "telugu": {
        "PTP": "Agent: Vayida eppudu vastundi? Borrower: {date} na {amount} rupayalu tappakunda pampistanu.",
        "PAID": "Agent: Oka vayida migilindi. Borrower: Adi poyina varam khata nunchi velli poyindi.",
        "WRONG_NUMBER": "Agent: Meera garu unnara? Borrower: Aa perutho ikkada evaru leru.",
        "DENIED": "Agent: Appu gaduvu datindi. Borrower: Pani poyindi, dabbulu levu.",
        "VISIT": "Agent: Ela kadataru? Borrower: Evarinaina intiki pampandi, nagadu unchanu.",
    },
    "kannada": {
        "PTP": "Agent: Kantu yavaga barutte? Borrower: {date} randu {amount} rupayi khandita kalisuttene.",
        "PAID": "Agent: Ondu kantu baaki ide. Borrower: Adu hoda vaara khateyinda hogide.",
        "WRONG_NUMBER": "Agent: Meera iddara? Borrower: Aa hesarinavaru illi yaaru illa.",
        "DENIED": "Agent: Saala baaki ide. Borrower: Kelasa hoyitu, hana illa.",
        "VISIT": "Agent: Hege kattuttiri? Borrower: Yaarannadaru manege kalisi, nagadu ittiddene.",
    },
    "malayalam": {
        "PTP": "Agent: Gadu eppol varum? Borrower: {date} nu {amount} rupa urappayum ayakkam.",
        "PAID": "Agent: Oru gadu baaki undu. Borrower: Athu kazhinja aazhcha account il ninnu poyi.",
        "WRONG_NUMBER": "Agent: Meera undo? Borrower: Aa peril ivide aarum illa.",
        "DENIED": "Agent: Vaypa mudangi. Borrower: Joli poyi, paisa illa.",
        "VISIT": "Agent: Engane adakkum? Borrower: Aareyenkilum veettilekku vidu, panam eduthu vechittundu.",
    },
}
FALLBACK_LANGUAGE = "english"


def gold_seeds(spark: SparkSession, languages: list[str], per_language: int) -> DataFrame:
    """(language, seed) with seeds 0..n-1 for every language, from one distributed range."""
    names = F.array(*[F.lit(language) for language in languages])
    return spark.range(per_language * len(languages)).select(
        F.element_at(names, (F.col("id") % len(languages) + 1).cast("int")).alias("language"),
        F.floor(F.col("id") / len(languages)).alias("seed"),
    )


def draw(choice: str, key: Column, salt: str) -> Column:
    """Number from 0 to 2^32-1 for one choice about one record."""
    digest = F.md5(F.concat_ws("|", F.lit(choice), F.lit(salt), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _scenario(percent: Column) -> Column:
    chosen, upto = F, 0
    for scenario, weight in SCENARIO_WEIGHTS.items():
        upto += weight
        chosen = chosen.when(percent < upto, F.lit(scenario))
    return chosen


def draw_scenarios(seeds: DataFrame, salt: str = "") -> DataFrame:
    """Adds ``id``, ``scenario``, ``amount`` and ``date`` to (language, seed) rows."""
    days = GOLD_LAST_DAY - GOLD_FIRST_DAY + 1
    amounts = F.array(*[F.lit(amount) for amount in GOLD_AMOUNTS])
    key = F.col("id")
    drawn = seeds.withColumn(
        "id", F.concat_ws("_", F.col("language"), F.col("seed").cast("string"))
    ).withColumns(
        {
            "_percent": draw("scenario", key, salt) % sum(SCENARIO_WEIGHTS.values()),
            "_amount_no": draw("amount", key, salt) % len(GOLD_AMOUNTS) + 1,
            "_day": draw("date", key, salt) % days + GOLD_FIRST_DAY,
        }
    )
    return drawn.withColumns(
        {
            "scenario": _scenario(F.col("_percent")),
            "amount": F.element_at(amounts, F.col("_amount_no").cast("int")),
            "date": F.concat(F.lit("2026-03-"), F.lpad(F.col("_day").cast("string"), 2, "0")),
        }
    ).drop("_percent", "_amount_no", "_day")


def fill_template(template: Column, amount: Column, date: Column) -> Column:
    with_amount = F.replace(template, F.lit("{amount}"), amount.cast("string"))
    return F.replace(with_amount, F.lit("{date}"), date)


def add_transcripts(
    drawn: DataFrame, templates: dict[str, dict[str, str]] | None = None
) -> DataFrame:
    """Adds ``transcript``; a language without templates uses the English ones.

    Templates must cover every scenario of their language, and the fallback language must be
    there; otherwise this raises before any work, as rows would be lost.
    """
    spark, given = drawn.sparkSession, dict(templates or TEMPLATES)
    given.setdefault(FALLBACK_LANGUAGE, TEMPLATES[FALLBACK_LANGUAGE])
    for language, by_kind in given.items():
        missing = sorted(set(SCENARIO_WEIGHTS) - set(by_kind))
        if missing:
            raise ValueError(f"no template of {language} for {missing}")
    rows = [(lang, kind, text) for lang, by_kind in given.items() for kind, text in by_kind.items()]
    table = spark.createDataFrame(rows, "_language STRING, scenario STRING, _template STRING")
    known = F.col("language").isin(list(given))
    return (
        drawn.withColumn(
            "_language", F.when(known, F.col("language")).otherwise(F.lit(FALLBACK_LANGUAGE))
        )
        .join(table, ["_language", "scenario"])
        .withColumn(
            "transcript", fill_template(F.col("_template"), F.col("amount"), F.col("date"))
        )
        .drop("_language", "_template")
    )


def scenario_truth(drawn: DataFrame) -> DataFrame:
    """Adds the expected outcome of each scenario, from a table of five rows."""
    table = drawn.sparkSession.createDataFrame(
        SCENARIO_TRUTH,
        "scenario STRING, expected_disposition STRING, expected_payment_disposition STRING, "
        "expected_reason_for_not_paying STRING, _promised BOOLEAN",
    )
    return (
        drawn.join(F.broadcast(table), "scenario")
        .withColumns(
            {
                "expected_amount": F.when(F.col("_promised"), F.col("amount")),
                "expected_date": F.when(F.col("_promised"), F.col("date")),
                "expected_remarks": F.lit(GOLD_REMARKS),
            }
        )
        .drop("_promised")
    )


def synth_gold(
    seeds: DataFrame, templates: dict[str, dict[str, str]] | None = None, salt: str = ""
) -> DataFrame:
    """Gold records, one per (language, seed) row."""
    return scenario_truth(add_transcripts(draw_scenarios(seeds, salt), templates)).select(
        "language",
        "id",
        "transcript",
        "expected_disposition",
        "expected_payment_disposition",
        "expected_reason_for_not_paying",
        "expected_amount",
        "expected_date",
        "expected_remarks",
    )
