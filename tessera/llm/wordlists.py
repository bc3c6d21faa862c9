"""Common words of the corpus's languages."""

#: Frequent function words of English, French, German and Spanish.
BY_LANGUAGE = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au plus ne se ce il pas avec son",
    "de": "der die und den von zu das mit sich dem ein eine nicht im auf ist es auch als an er hat aus bei",
    "es": "de la el y en los las que se del un una con no su por para al lo como más o pero sus ha sin este",
}
COMMON_WORDS = tuple(dict.fromkeys(" ".join(BY_LANGUAGE.values()).split()))
