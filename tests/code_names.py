"""Names of the activity codes that the reports look for: fixed values, an excerpt of the survey's list."""

ACTIVITY_NAMES = (
    ("010101", "Sleeping"),
    ("010102", "Sleeplessness"),
    ("010199", "Sleeping, n.e.c.*"),
    ("020201", "Food and drink preparation"),
    ("020202", "Food presentation"),
    ("020203", "Kitchen and food clean-up"),
    ("020299", "Food & drink prep, presentation, & clean-up, n.e.c.*"),
    ("020501", "Lawn, garden, and houseplant care"),
    ("020599", "Lawn and garden, n.e.c.*"),
    ("020905", "Home security"),
    ("030111", "Waiting for/with hh children"),
    ("030204", "Waiting associated with hh children's education"),
    ("030303", "Waiting associated with hh children's health"),
    ("030405", "Waiting associated with caring for household adults"),
    ("030504", "Waiting associated with helping hh adults"),
    ("040111", "Waiting for/with nonhh children"),
    ("040204", "Waiting associated with nonhh children's education"),
    ("040303", "Waiting associated with nonhh children's health"),
    ("040405", "Waiting associated with caring for nonhh adults"),
    ("040508", "Waiting associated with helping nonhh adults"),
    ("050103", "Security procedures related to work"),
    ("050104", "Waiting associated with working"),
    ("050201", "Socializing, relaxing, and leisure as part of job"),
    ("050204", "Security procedures as part of job"),
    ("050205", "Waiting associated with work-related activities"),
    ("050305", "Waiting associated with other income-generating activities"),
    ("050401", "Job search activities"),
    ("050403", "Job interviewing"),
    ("050404", "Waiting associated with job search or interview"),
    ("050405", "Security procedures rel. to job search/interviewing"),
    ("050499", "Job search and Interviewing, n.e.c.*"),
    ("060103", "Waiting associated with taking classes"),
    ("060104", "Security procedures rel. to taking classes"),
    ("060204", "Waiting associated with extracurricular activities"),
    ("060303", "Waiting associated with research/homework"),
    ("060403", "Waiting associated w/admin. activities (education)"),
    ("070101", "Grocery shopping"),
    ("070102", "Purchasing gas"),
    ("070103", "Purchasing food (not groceries)"),
    ("070104", "Shopping, except groceries, food and gas"),
    ("070105", "Waiting associated with shopping"),
    ("070199", "Shopping, n.e.c.*"),
    ("070301", "Security procedures rel. to consumer purchases"),
    ("070399", "Security procedures rel. to consumer purchases, n.e.c.*"),
    ("080102", "Waiting associated w/purchasing childcare svcs"),
    ("080203", "Waiting associated w/banking/financial services"),
    ("080302", "Waiting associated with legal services"),
    ("080403", "Waiting associated with medical services"),
    ("080502", "Waiting associated w/personal care services"),
    ("080602", "Waiting associated w/purchasing/selling real estate"),
    ("080702", "Waiting associated with veterinary services"),
    ("080801", "Security procedures rel. to professional/personal svcs."),
    ("080899", "Security procedures rel. to professional/personal svcs n.e.c.*"),
    ("090104", "Waiting associated with using household services"),
    ("090202", "Waiting associated w/ home main/repair/décor/constr"),
    ("090302", "Waiting associated with pet services"),
    ("090401", "Using lawn and garden services"),
    ("090402", "Waiting associated with using lawn & garden services"),
    ("090499", "Using lawn and garden services, n.e.c.*"),
    ("090502", "Waiting associated with vehicle main. or repair svcs"),
    ("100304", "Waiting associated with using government services"),
    ("100305", "Waiting associated with civic obligations & participation"),
    ("100399", "Waiting assoc. w/govt svcs or civic obligations, n.e.c.*"),
    ("100401", "Security procedures rel. to govt svcs/civic obligations"),
    ("100499", "Security procedures rel. to govt svcs/civic obligations, n.e.c.*"),
    ("110201", "Waiting associated w/eating & drinking"),
    ("110299", "Waiting associated with eating & drinking, n.e.c.*"),
    ("120301", "Relaxing, thinking"),
    ("120302", "Tobacco and drug use"),
    ("120303", "Television and movies (not religious)"),
    ("120304", "Television (religious)"),
    ("120305", "Listening to the radio"),
    ("120306", "Listening to/playing music (not radio)"),
    ("120307", "Playing games"),
    ("120308", "Computer use for leisure (exc. Games)"),
    ("120309", "Arts and crafts as a hobby"),
    ("120310", "Collecting as a hobby"),
    ("120311", "Hobbies, except arts & crafts and collecting"),
    ("120312", "Reading for personal interest"),
    ("120313", "Writing for personal interest"),
    ("120399", "Relaxing and leisure, n.e.c.*"),
    ("120405", "Security procedures rel. to arts & entertainment"),
    ("120501", "Waiting assoc. w/socializing & communicating"),
    ("120502", "Waiting assoc. w/attending/hosting social events"),
    ("120503", "Waiting associated with relaxing/leisure"),
    ("120504", "Waiting associated with arts & entertainment"),
    ("120599", "Waiting associated with socializing, n.e.c.*"),
    ("129999", "Socializing, relaxing, and leisure, n.e.c.*"),
    ("130101", "Doing aerobics"),
    ("130102", "Playing baseball"),
    ("130103", "Playing basketball"),
    ("130104", "Biking"),
    ("130105", "Playing billiards"),
    ("130106", "Boating"),
    ("130107", "Bowling"),
    ("130108", "Climbing, spelunking, caving"),
    ("130109", "Dancing"),
    ("130110", "Participating in equestrian sports"),
    ("130111", "Fencing"),
    ("130112", "Fishing"),
    ("130113", "Playing football"),
    ("130114", "Golfing"),
    ("130115", "Doing gymnastics"),
    ("130116", "Hiking"),
    ("130117", "Playing hockey"),
    ("130118", "Hunting"),
    ("130119", "Participating in martial arts"),
    ("130120", "Playing racquet sports"),
    ("130121", "Participating in rodeo competitions"),
    ("130122", "Rollerblading"),
    ("130123", "Playing rugby"),
    ("130124", "Running"),
    ("130125", "Skiing, ice skating, snowboarding"),
    ("130126", "Playing soccer"),
    ("130127", "Softball"),
    ("130128", "Using cardiovascular equipment"),
    ("130129", "Vehicle touring/racing"),
    ("130130", "Playing volleyball"),
    ("130131", "Walking"),
    ("130132", "Participating in water sports"),
    ("130133", "Weightlifting/strength training"),
    ("130134", "Working out, unspecified"),
    ("130135", "Wrestling"),
    ("130136", "Doing yoga"),
    ("130199", "Playing sports n.e.c.*"),
    ("130301", "Waiting related to playing sports or exercising"),
    ("130302", "Waiting related to attending sporting events"),
    ("130399", "Waiting associated with sports, exercise, & recreation, n.e.c.*"),
    ("130401", "Security related to playing sports or exercising"),
    ("130402", "Security related to attending sporting events"),
    ("130499", "Security related to sports, exercise, & recreation, n.e.c.*"),
    ("140103", "Waiting associated w/religious & spiritual activities"),
    ("140104", "Security procedures rel. to religious & spiritual activities"),
    ("150701", "Waiting associated with volunteer activities"),
    ("150799", "Waiting associated with volunteer activities, n.e.c.*"),
    ("150801", "Security procedures related to volunteer activities"),
    ("150899", "Security procedures related to volunteer activities, n.e.c.*"),
    ("160201", "Waiting associated with telephone calls"),
    ("160299", "Waiting associated with telephone calls, n.e.c.*"),
    ("180205", "Travel related to lawn, garden, and houseplant care"),
    ("180504", "Travel related to job search & interviewing"),
    ("180701", "Travel related to grocery shopping"),
    ("180904", "Travel related to using lawn and garden services"),
    ("181203", "Travel related to relaxing and leisure"),
    ("181299", "Travel rel. to socializing, relaxing, & leisure, n.e.c.*"),
    ("181801", "Security procedures related to traveling"),
    ("181899", "Security procedures related to traveling, n.e.c.*"),
)
