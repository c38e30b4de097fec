"""Compound doctrine terms that queries match as phrases."""

#: Fixed values.
PHRASES = frozenset(
    p.strip()
    for p in """
first amendment, second amendment, fourth amendment, fifth amendment, sixth amendment, fourteenth amendment, takings clause, equal protection,
strict scrutiny, intermediate scrutiny, rational basis, procedural due process, substantive due process, commerce clause, dormant commerce clause,
substantial effects, interstate commerce, necessary and proper, supremacy clause, separation of powers, executive privilege, political question,
sovereign immunity, full faith and credit, privileges and immunities, free speech, free exercise, establishment clause, prior restraint, actual malice,
cruel and unusual punishment, double jeopardy, self incrimination, confrontation clause, keep and bear arms, public use,
probable cause, reasonable suspicion, reasonable doubt, beyond a reasonable doubt, miranda warnings, custodial interrogation, warrantless search,
warrantless seizure, plain view, exclusionary rule, good faith exception, inevitable discovery, independent source, exigent circumstances,
search incident to arrest, habeas corpus, plea bargain, guilty plea, ineffective assistance of counsel, excessive force, false arrest,
false imprisonment, malicious prosecution, section 1983,
summary judgment, directed verdict, class action, best evidence, collateral estoppel, res judicata, statute of limitations, statute of frauds,
burden of proof, preponderance of the evidence, clear and convincing evidence, attorney client privilege, personal jurisdiction,
subject matter jurisdiction, long arm statute, forum non conveniens, choice of law, minimum contacts,
proximate cause, negligence per se, res ipsa loquitur, comparative negligence, contributory negligence, contributory fault, assumption of risk,
products liability, strict liability, punitive damages, compensatory damages, liquidated damages, informed consent, medical malpractice,
wrongful death, loss of consortium,
breach of contract, promissory estoppel, parol evidence rule, specific performance, adverse possession, eminent domain, just compensation,
regulatory taking, regulatory takings, qualified immunity, official immunity,
hostile work environment, disparate impact, disparate treatment, at will employment, chevron deference, arbitrary and capricious,
substantial evidence, notice and comment, rule of reason, restraint of trade, public accommodations, fiduciary duty, business judgment rule,
piercing the corporate veil, joint and several liability
""".replace("\n", " ").split(",")
)
